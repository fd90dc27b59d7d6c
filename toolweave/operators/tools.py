"""Deduplication, filters, joins and labels over tables of tools.

``tools`` has tool_id, source_file, name, description, category, domain and input_schema. Order is (source_file,
tool_id): it stands for the order of files and of the tools in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolweave.functions import text as tx

# Parameter names that describe a schema rather than a real parameter.
META_NAMES = ["additionalProperties", "$schema", "dummy", "title", "random_string", "weekly_id", "id", "type", "description"]
# The label spaces.
CATEGORIES = ["analysis", "operations", "system", "visualization", "search", "generate"]
DOMAINS = ["finance", "technology", "education", "healthcare", "entertainment", "travel", "business", "lifestyle", "science", "social", "sports", "environment", "culture"]


def _one_by(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    """One row per key by aggregation, which combines before the shuffle: a key that a third of all rows share is no hot task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = pick(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*[F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns])


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, ties by the other columns; null keys are equal to one another."""
    return _one_by(df, keys, order, F.min)


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return _one_by(df, keys, order, F.max)


def dedup_first(tools: DataFrame) -> DataFrame:
    """One tool per stripped name and description; tools without a usable name are kept (q3)."""
    key = [tx.strip(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in ("name", "description")]
    named = ~tx.blank(F.col("name"))
    rows = tools.withColumn("_name", key[0]).withColumn("_description", key[1])
    first = first_by(rows.where(named), ["_name", "_description"], ["source_file", "tool_id"])
    return first.unionByName(rows.where(~named)).drop("_name", "_description")


def dedup_across_files(tools: DataFrame, special: list[str], mode: str = "drop_all") -> DataFrame:
    """Within a file the first of equal (name, description) stays; across files a pair that stands in
    any other file is dropped from every ordinary file ('drop_all'), or kept in its first file ('keep_first').

    Files in ``special`` are copied unchanged; tools without a usable name are kept.
    """
    kept = F.col("source_file").isin(special) | tx.blank(F.col("name"))
    pair = ["name", "description"]
    # One row per file and pair, by aggregation; then a pair has at most as many rows as there are files.
    first = first_by(tools.where(~tx.blank(F.col("name"))), ["source_file", *pair], ["tool_id"])
    by_pair = Window.partitionBy(*pair)
    rows = first.withColumn("_low", F.min("source_file").over(by_pair)).withColumn("_high", F.max("source_file").over(by_pair))
    stays = F.col("_low") == F.col("_high") if mode == "drop_all" else F.col("source_file") == F.col("_low")
    return tools.where(kept).unionByName(rows.where(stays & ~kept).drop("_low", "_high"))


def file_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """A1: (source_file, total, kept, removed, pct) by file and, under null, in total."""
    flags = before.select("tool_id", "source_file").join(after.select("tool_id", F.lit(1).alias("_k")), "tool_id", "left")
    by = flags.rollup("source_file").agg(F.count(F.lit(1)).alias("total"), F.count("_k").alias("kept"))
    removed = F.col("total") - F.col("kept")
    return by.select("source_file", "total", "kept", removed.alias("removed"), F.round(100 * removed / F.col("total"), 2).alias("pct"))


def schema_properties(schema: Column) -> Column:
    """Names of the parameters of a schema, null where it has no properties object."""
    inside = F.get_json_object(schema, "$.properties")
    return F.when(inside.rlike(r"^\s*\{"), F.json_object_keys(inside))


def without_empty_schema(tools: DataFrame, schema: str = "input_schema") -> DataFrame:
    """drop tools whose schema has no properties, or only metadata names; a schema that is missing or no
    object stays, and so does one whose properties are no object."""
    known = F.col(schema).rlike(r"^\s*\{") & F.try_parse_json(schema).isNotNull()
    inside = F.get_json_object(schema, "$.properties")
    bare = inside.isNull() | (F.size(F.array_except(schema_properties(F.col(schema)), F.array(*[F.lit(x) for x in META_NAMES]))) == 0)
    return tools.where(~F.coalesce(known & bare, F.lit(False)))


def time_tools(tools: DataFrame, schema: str = "input_schema") -> DataFrame:
    """tools that speak of time in their description, or in the names, descriptions or required names of
    their parameters."""
    inside = F.from_json(F.get_json_object(schema, "$.properties"), "map<string,string>")
    names = F.coalesce(schema_properties(F.col(schema)), F.array().cast("array<string>"))
    texts = F.coalesce(F.transform(F.map_values(inside), lambda v: F.get_json_object(v, "$.description")), F.array().cast("array<string>"))
    needed = F.coalesce(F.from_json(F.get_json_object(schema, "$.required"), "array<string>"), F.array().cast("array<string>"))
    every = F.concat(F.array("description"), names, texts, needed)
    return tools.where(F.exists(F.array_compact(every), tx.time_bound))


def cjk_tools(tools: DataFrame) -> DataFrame:
    """Tools with an ideograph in any text field."""
    return tools.where(F.concat_ws(" ", "name", "description", "category", "domain", "input_schema").rlike(tx.CJK_TOOL))


def rejected(tools: DataFrame) -> DataFrame:
    """(tool_id, reason) of tools without a name or, in their own or their schema's text, a description."""
    described = ~tx.blank(F.col("description")) | ~tx.blank(F.get_json_object("input_schema", "$.description"))
    reason = F.when(tx.blank(F.col("name")), "no_name").when(~described, "no_description")
    return tools.select("tool_id", reason.alias("reason")).where("reason IS NOT NULL")


def label_state(c: Column) -> Column:
    """null, empty_string, empty_list or valid."""
    return F.when(c.isNull(), "null").when(tx.strip(c) == "", "empty_string").when(tx.strip(c).isin("[]", "{}"), "empty_list").otherwise("valid")


def label_status(tools: DataFrame) -> DataFrame:
    """A3: (category_state, domain_state, n)."""
    return tools.groupBy(label_state(F.col("category")).alias("category_state"), label_state(F.col("domain")).alias("domain_state")).agg(F.count(F.lit(1)).alias("n"))


def reference_labels(labels: DataFrame) -> DataFrame:
    """The label row of each (name, description): the last with both labels, else the first that has one."""
    key = [tx.collapsed(F.coalesce(c, F.lit(""))) for c in ("name", "description")]
    rows = labels.select(key[0].alias("k_name"), key[1].alias("k_description"), "tool_id", *[F.nullif(tx.strip(F.col(c)), F.lit("")).alias(c) for c in ("category", "domain")])
    both = F.col("category").isNotNull() & F.col("domain").isNotNull()
    rows = rows.where("category IS NOT NULL OR domain IS NOT NULL")
    best = F.coalesce(F.max_by(F.struct("category", "domain"), F.when(both, F.col("tool_id"))), F.min_by(F.struct("category", "domain"), F.col("tool_id")))
    return rows.groupBy("k_name", "k_description").agg(best.alias("_l")).select("k_name", "k_description", F.col("_l.category").alias("r_category"), F.col("_l.domain").alias("r_domain"))


def enrich_labels(tools: DataFrame, labels: DataFrame) -> DataFrame:
    """(tool_id, category, domain, matched): missing labels filled from the reference; present ones stay."""
    ref = reference_labels(labels).withColumn("matched", F.lit(True))
    keyed = tools.withColumn("k_name", tx.collapsed(F.coalesce("name", F.lit("")))).withColumn("k_description", tx.collapsed(F.coalesce("description", F.lit(""))))
    joined = keyed.join(ref, ["k_name", "k_description"], "left")
    fill = lambda c: F.coalesce(F.nullif(tx.strip(F.col(c)), F.lit("")), F.col(f"r_{c}")).alias(c)
    return joined.select("tool_id", fill("category"), fill("domain"), F.coalesce("matched", F.lit(False)).alias("matched"))


def used_tools(tools: DataFrame, used: DataFrame, keep: bool = True) -> DataFrame:
    """Tools whose whitespace-free (name, description) is used, or the others."""
    key = lambda df: df.withColumn("_n", tx.signature(F.col("name"))).withColumn("_d", tx.signature(F.col("description")))
    marks = key(used).select("_n", "_d").distinct()
    return key(tools).join(marks, ["_n", "_d"], "left_semi" if keep else "left_anti").drop("_n", "_d")


def used_by_name(tools: DataFrame, names: DataFrame, keep: bool = True) -> DataFrame:
    """Tools whose whitespace-free name is among the names, or the others."""
    marks = names.select(tx.signature(F.col("name")).alias("_n")).distinct()
    return tools.withColumn("_n", tx.signature(F.col("name"))).join(marks, "_n", "left_semi" if keep else "left_anti").drop("_n")


def lookup(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls + tool_id of the last tool of that name, else of the last of that name without case."""
    exact = tools.where("name IS NOT NULL").groupBy("name").agg(F.max("tool_id").alias("_exact"))
    loose = tools.where("name IS NOT NULL").groupBy(F.lower("name").alias("_lower")).agg(F.max("tool_id").alias("_loose"))
    joined = calls.withColumn("_lower", F.lower("name")).join(exact, "name", "left").join(loose, "_lower", "left")
    return joined.withColumn("tool_id", F.coalesce("_exact", "_loose")).drop("_lower", "_exact", "_loose")


def first_of_name(tools: DataFrame) -> DataFrame:
    """(name, tool_id): the first pool entry of each name by file and place."""
    return tools.where("name IS NOT NULL").groupBy("name").agg(F.min(F.struct("source_file", "tool_id")).alias("_f")).select("name", F.col("_f.tool_id").alias("tool_id"))


def allowed_by_listed(listed: DataFrame, allowed: DataFrame, columns: list[str]) -> DataFrame:
    """(conv_id) of conversations with a listed tool that is not allowed; tools are compared by
    their stripped ``columns``, blank names are skipped."""
    keyed = listed.where(~tx.blank(F.col("name"))).select("conv_id", *[tx.strip(F.coalesce(c, F.lit(""))).alias(c) for c in columns])
    marks = allowed.select(*[tx.strip(F.coalesce(c, F.lit(""))).alias(c) for c in columns]).distinct()
    return keyed.join(marks, columns, "left_anti").select("conv_id").distinct()


def allowed_by_called(calls: DataFrame, listed: DataFrame, allowed: DataFrame) -> DataFrame:
    """(conv_id) of conversations with a call whose tool is not allowed; its description is that of the
    last listed tool of the name, '' where the conversation does not list it (q14)."""
    own = listed.where("name IS NOT NULL").groupBy("conv_id", "name").agg(F.max_by("description", "tool_pos").alias("description"))
    pairs = calls.select("conv_id", "name").distinct().join(own, ["conv_id", "name"], "left")
    keyed = pairs.select("conv_id", tx.strip(F.col("name")).alias("name"), tx.strip(F.coalesce("description", F.lit(""))).alias("description"))
    marks = allowed.select(tx.strip(F.coalesce("name", F.lit(""))).alias("name"), tx.strip(F.coalesce("description", F.lit(""))).alias("description")).distinct()
    return keyed.join(marks, ["name", "description"], "left_anti").select("conv_id").distinct()


def name_overlap(tools: DataFrame) -> DataFrame:
    """(file_a, file_b, common): distinct names two files share; joined on the name, not on pairs of files."""
    names = tools.where("name IS NOT NULL").select("source_file", "name").distinct()
    a, b = names.withColumnRenamed("source_file", "file_a"), names.withColumnRenamed("source_file", "file_b")
    return a.join(b, "name").where("file_a < file_b").groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("common"))


def inverse_frequency(tools: DataFrame, label: str, space: list[str], alpha: float = 1.0) -> DataFrame:
    """A10: (label, n, weight): 1 / (n + alpha) over the label space, normalised to 1; unseen labels count 0."""
    spark = tools.sparkSession
    labels = spark.createDataFrame([(x,) for x in space], f"{label} string")
    counts = tools.groupBy(F.lower(tx.strip(F.col(label))).alias(label)).agg(F.count(F.lit(1)).alias("n"))
    raw = labels.join(counts, label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n")).withColumn("_w", 1.0 / (F.col("n") + F.lit(alpha)))
    return raw.select(label, "n", F.round(F.col("_w") / F.sum("_w").over(Window.partitionBy()), 9).alias("weight"))


def usage(calls: DataFrame) -> DataFrame:
    """(name, n) calls by tool."""
    return calls.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def top_bottom(usages: DataFrame, k: int = 5) -> DataFrame:
    """(side, rank, name, n): the most and the least used tools, ties by name."""
    top = usages.orderBy(F.desc("n"), "name").limit(k).withColumn("side", F.lit("top"))
    bottom = usages.orderBy("n", "name").limit(k).withColumn("side", F.lit("bottom"))
    by = Window.partitionBy("side").orderBy(F.when(F.col("side") == "top", -F.col("n")).otherwise(F.col("n")), "name")
    return top.unionByName(bottom).select("side", F.row_number().over(by).alias("rank"), "name", "n")


def next_id(df: DataFrame, column: str) -> DataFrame:
    """(next_id): the greatest numeric id plus 1, 1 where there is none; other ids are ignored."""
    return df.agg((F.coalesce(F.max(F.expr(f"try_cast(`{column}` AS BIGINT)")), F.lit(0)) + 1).alias("next_id"))


def suffix_lookup(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Calls + matched name: the called name itself, else without a numeric suffix; null where neither is listed."""
    names = functions.select(F.col("name").alias("_f")).distinct()
    base = F.regexp_replace("name", r"_\d+$", "")
    out = calls.withColumn("_base", base).join(names.select("_f", F.col("_f").alias("_exact")), F.col("name") == F.col("_f"), "left").drop("_f")
    out = out.join(names.select("_f", F.col("_f").alias("_cut")), F.col("_base") == F.col("_f"), "left").drop("_f")
    return out.withColumn("matched", F.coalesce("_exact", "_cut")).drop("_base", "_exact", "_cut")


def domain_pool(tools: DataFrame, domain: str, category: str | None = None) -> DataFrame:
    """the tools of a domain, and of a category where one is given, case apart."""
    same = lambda c, v: F.lower(tx.strip(F.col(c))) == v.lower()
    return tools.where(same("domain", domain) if category is None else same("domain", domain) & same("category", category))


def file_match(predictions: DataFrame, truths: DataFrame) -> DataFrame:
    """(prediction, truth): files by the data set their names stand for, of several truths the first by name."""
    named = truths.select(tx.dataset_name(F.col("file")).alias("_d"), F.col("file").alias("truth")).groupBy("_d").agg(F.min("truth").alias("truth"))
    return predictions.select(F.col("file").alias("prediction"), tx.dataset_name(F.col("file")).alias("_d")).join(named, "_d", "left").drop("_d")
