"""Quality scores, call matching and evaluation metrics."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolweave.functions import jsonx as jx
from toolweave.functions import text as tx
from toolweave.operators.sampling import hash_rank

METRICS = ["toolfit", "clarity", "naturalness", "success", "grounding", "efficiency"]
DIMENSIONS = ["single-hop", "multi-hop", "single-turn", "multi-turn"]


def mean_of(columns: list[str]) -> Column:
    """The mean of the values that are not null; null where all are."""
    known = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.nullif(F.size(known), F.lit(0)))


def least_of(columns: list[str]) -> Column:
    return F.array_min(F.array(*[F.col(c).cast("double") for c in columns]))


def scored(df: DataFrame, columns: list[str] = METRICS) -> DataFrame:
    """+ average (6 digits) and min_score over the metrics that are not null (q19)."""
    return df.withColumn("average", F.round(mean_of(columns), 6)).withColumn("min_score", least_of(columns))


def quality_gate(df: DataFrame, least: float = 4, mean: float = 8) -> DataFrame:
    """+ passed and reason; null scores fail."""
    reason = (
        F.when(F.col("average").isNull(), "no_scores").when((F.col("min_score") < least) & (F.col("average") < mean), "min_and_mean")
        .when(F.col("min_score") < least, "min").when(F.col("average") < mean, "mean").otherwise("ok")
    )
    return df.withColumn("reason", reason).withColumn("passed", F.col("reason") == "ok")


def fail_reasons(gated: DataFrame) -> DataFrame:
    """(reason, n) of the rows that failed."""
    return gated.where("NOT passed").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def score_summary(gated: DataFrame) -> DataFrame:
    """One row: how many passed and failed, and the mean of the averages."""
    return gated.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.round(F.avg("average"), 6).alias("mean_average"))


def score_delta(augmented: DataFrame, original: DataFrame, key: str, columns: list[str] = METRICS) -> DataFrame:
    """(key, <metric>_delta): augmented minus original, null where either is."""
    other = original.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return augmented.join(other, key, "left").select(key, *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in columns])


def passed_variants(variants: DataFrame, key: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(kind, n_passed, n_failed) by type of variant, and (key, any_passed) by document."""
    by_kind = variants.groupBy(kind).agg(F.count_if("passed").alias("n_passed"), F.count_if(~F.col("passed")).alias("n_failed"))
    return by_kind, variants.groupBy(key).agg(F.bool_or("passed").alias("any_passed"))


def episode_scores(turns: DataFrame, episode: str) -> DataFrame:
    """(episode, total, min_score): 0.4 query + 0.4 trajectory + 0.2 anchor over the turns of an episode.

    query is the mean of toolfit, clarity and naturalness of all turns, trajectory that of the other three;
    total is null where a component is; min_score is over all scores that are there.
    """
    query, trajectory = METRICS[:3], METRICS[3:]
    total = lambda cs: reduce(lambda a, b: a + b, [F.coalesce(F.sum(c), F.lit(0)) for c in cs])
    number = lambda cs: reduce(lambda a, b: a + b, [F.count(c) for c in cs])
    mean = lambda cs: F.try_divide(total(cs).cast("double"), number(cs))
    low = F.least(*[F.min(c) for c in [*METRICS, "anchor"]])
    by = turns.groupBy(episode).agg(mean(query).alias("_q"), mean(trajectory).alias("_t"), F.avg("anchor").alias("_a"), low.cast("double").alias("min_score"))
    return by.select(episode, F.round(0.4 * F.col("_q") + 0.4 * F.col("_t") + 0.2 * F.col("_a"), 6).alias("total"), "min_score")


def call_range(docs: DataFrame, calls: str, least: int = 2, most: int = 5) -> DataFrame:
    """+ state: no_calls, in_range or out_of_range."""
    return docs.withColumn("state", F.when(F.coalesce(calls, F.lit(0)) == 0, "no_calls").when(F.col(calls).between(least, most), "in_range").otherwise("out_of_range"))


def anchored(text: Column, anchors: Column) -> Column:
    """some anchor that is not null stands in the text, case apart; no anchors pass."""
    known = F.filter(anchors, lambda a: a.isNotNull())
    return (F.size(F.coalesce(known, F.array().cast("array<string>"))) == 0) | F.coalesce(F.exists(known, lambda a: F.contains(F.lower(text), F.lower(a))), F.lit(False))


def ungrounded(values: Column, text: Column) -> Column:
    """F16: the argument values that do not stand in the text: booleans by their usual words, numbers not
    inside other numbers, strings without regard to case."""

    def stands(v: Column) -> Column:
        low = F.lower(text)
        yes, no = low.rlike(r"\b(true|yes|enable|enabled|on|with|include)\b"), low.rlike(r"\b(false|no|not|disable|disabled|off|without|exclude)\b")
        number = F.regexp_like(text, F.concat(F.lit(r"(^|[^0-9.])"), F.regexp_replace(v, r"\.", r"\\."), F.lit(r"([^0-9.]|\.[^0-9]|\.?$)")))
        return F.when(F.lower(v) == "true", yes).when(F.lower(v) == "false", no).when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), number).otherwise(F.contains(low, F.lower(v)))

    return F.filter(values, lambda v: ~F.coalesce(stands(v), F.lit(False)))


def user_sourced(calls: Column) -> Column:
    """every planned call of an array (structs with args_source.field) takes its arguments from the user; no calls pass."""
    return F.forall(F.coalesce(calls, F.array().cast("array<struct<args_source:struct<field:string>>>")), lambda c: F.coalesce(c["args_source"]["field"] == "user", F.lit(False)))


def missing_required(required: Column, given: Column) -> Column:
    """the required names that are not given."""
    return F.array_except(F.coalesce(required, F.array().cast("array<string>")), F.coalesce(given, F.array().cast("array<string>")))


def completeness(result: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """(key, state): complete, has_null, or incomplete where calls or answers are fewer than the source's."""
    joined = source.select(key, F.col("n_calls").alias("_c"), F.col("n_answers").alias("_a")).join(result, key, "left")
    enough = (F.coalesce("n_calls", F.lit(0)) >= F.col("_c")) & (F.coalesce("n_answers", F.lit(0)) >= F.col("_a"))
    return joined.select(key, F.when(~enough, "incomplete").when(F.coalesce("n_null", F.lit(0)) > 0, "has_null").otherwise("complete").alias("state"))


def rouge_l(a: str | None, b: str | None) -> float:
    """F1 of the longest common subsequence of white-space words; 0 for nulls, 1 for two texts without words."""
    if a is None or b is None:
        return 0.0
    x, y = a.split(), b.split()
    if not x or not y:
        return float(x == y)
    row = [0] * (len(y) + 1)
    for w in x:
        before = 0
        for j, v in enumerate(y, 1):
            keep = row[j]
            row[j] = before + 1 if w == v else max(row[j], row[j - 1])
            before = keep
    return 2 * row[-1] / (len(x) + len(y))


def rouge_l_of(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([rouge_l(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def flexibly_equal(pred: str | None, truth: str | None, defaults: dict | None = None, least: float = 0.7) -> bool:
    """M1: argument objects with the same names after defaults are filled in, each value equal or, for texts,
    of a ROUGE-L of at least ``least``. Unreadable or null arguments count as {}."""
    a, b = (x if isinstance(x := jx.load(t), dict) else {} for t in (pred, truth))
    a, b = {**(defaults or {}), **a}, {**(defaults or {}), **b}
    return a.keys() == b.keys() and all(a[k] == b[k] or (isinstance(a[k], str) and isinstance(b[k], str) and rouge_l(a[k], b[k]) >= least) for k in a)


def flexible_accuracy(matched: DataFrame, pred: DataFrame, truth: DataFrame) -> DataFrame:
    """M1: (conv_id, turn, flexible_accuracy): the share of all predicted calls whose partner's arguments are
    flexibly equal. Only pairs that are not exact are compared in Python."""
    side = lambda df, p: df.select("conv_id", "turn", F.col("pos").alias(f"{p}_pos"), F.col("arguments").alias(f"{p}_arguments"))
    rest = matched.where("p_pos IS NOT NULL AND t_pos IS NOT NULL AND NOT exact")
    rest = rest.join(side(pred, "p"), ["conv_id", "turn", "p_pos"]).join(side(truth, "t"), ["conv_id", "turn", "t_pos"])

    @F.pandas_udf("boolean")
    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([flexibly_equal(p, q) for p, q in zip(x, y, strict=True)])

    good = rest.where(same("p_arguments", "t_arguments")).select("conv_id", "turn")
    exact = matched.where("exact").select("conv_id", "turn")
    hits = exact.unionByName(good).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("_h"))
    total = matched.groupBy("conv_id", "turn").agg(F.count("p_pos").alias("_p"))
    share = F.round(F.coalesce(F.try_divide(F.coalesce("_h", F.lit(0)), F.nullif("_p", F.lit(0))), F.lit(0.0)), 6)
    return total.join(hits, ["conv_id", "turn"], "left").select("conv_id", "turn", share.alias("flexible_accuracy"))


def match_calls(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(conv_id, turn, p_pos, t_pos, exact): calls (conv_id, turn, pos, name, arguments) of both sides paired.

    Names are compared stripped and in lower case. Inside a turn equal calls are paired first, in order;
    what is left is paired in order by name. Predicted calls without a partner have a null t_pos, true ones a null p_pos.
    """
    side = lambda df, p: df.select("conv_id", "turn", F.lower(tx.strip(F.col("name"))).alias("_n"), F.coalesce("arguments", F.lit("")).alias("_a"), F.lit(p).alias("_s"), "pos")
    # One shuffle by turn and name serves both windows and both groupings, whose keys all contain these.
    rows = side(pred, "p").unionByName(side(truth, "t")).repartition("conv_id", "turn", "_n")
    of = lambda s: F.max(F.when(F.col("_s") == s, F.col("pos"))).alias(f"{s}_pos")
    equal = ["conv_id", "turn", "_n", "_a"]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*equal, "_s").orderBy("pos")))
    first = rows.groupBy(*equal, "_r").agg(of("p"), of("t"))
    exact = F.col("p_pos").isNotNull() & F.col("t_pos").isNotNull()
    left = first.withColumn("_s", F.when(exact, "e").when(F.col("p_pos").isNotNull(), "p").otherwise("t")).withColumn("_o", F.coalesce("p_pos", "t_pos"))
    named = ["conv_id", "turn", "_n"]
    left = left.withColumn("_k", F.row_number().over(Window.partitionBy(*named, "_s").orderBy("_o", "t_pos"))).withColumn("exact", F.col("_s") == "e")
    second = left.groupBy(*named, "exact", "_k").agg(F.max("p_pos").alias("p_pos"), F.max("t_pos").alias("t_pos"))
    return second.select("conv_id", "turn", "p_pos", "t_pos", "exact")


def turn_metrics(matched: DataFrame) -> DataFrame:
    """M1: (conv_id, turn, n_pred, n_true, n_matched, strict_precision, flexible_precision, strict_accuracy).

    Accuracies divide by all predicted calls; a turn without predictions has zeros (q29).
    """
    both = F.col("p_pos").isNotNull() & F.col("t_pos").isNotNull()
    by = matched.groupBy("conv_id", "turn").agg(F.count("p_pos").alias("n_pred"), F.count("t_pos").alias("n_true"), F.count_if(both).alias("n_matched"), F.count_if(both & F.col("exact")).alias("n_exact"))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("n_pred")), F.lit(0.0)), 6)
    strict = F.when((F.col("n_pred") > 0) & (F.col("n_matched") == F.col("n_pred")), 1.0).otherwise(0.0)
    return by.select("conv_id", "turn", "n_pred", "n_true", "n_matched", strict.alias("strict_precision"), share("n_matched").alias("flexible_precision"), share("n_exact").alias("strict_accuracy"))


def dimension_metrics(metrics: DataFrame, by: list[str] = ()) -> DataFrame:
    """M2, A5: (by, dimension, n, strict_precision, flexible_precision, strict_accuracy).

    Hop dimensions average over turns (two or more true calls are multi-hop), turn dimensions over
    conversations, each the mean of its turns; a dimension without members has zeros.
    """
    by = list(by)
    values = ["strict_precision", "flexible_precision", "strict_accuracy"]
    turns = metrics.withColumn("dimension", F.when(F.col("n_true") >= 2, "multi-hop").otherwise("single-hop"))
    convs = metrics.groupBy(*by, "conv_id").agg(F.count(F.lit(1)).alias("_t"), *[F.avg(v).alias(v) for v in values])
    convs = convs.withColumn("dimension", F.when(F.col("_t") >= 2, "multi-turn").otherwise("single-turn"))
    rows = turns.select(*by, "dimension", *values).unionByName(convs.select(*by, "dimension", *values))
    grouped = rows.groupBy(*by, "dimension").agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(v) for v in values])
    labels = metrics.sparkSession.createDataFrame([(d,) for d in DIMENSIONS], "dimension string")
    wanted = metrics.select(*by).distinct().join(F.broadcast(labels)) if by else labels
    out = wanted.join(grouped, [*by, "dimension"], "left")
    return out.select(*by, "dimension", F.coalesce("n", F.lit(0)).alias("n"), *[F.round(F.coalesce(v, F.lit(0.0)), 6).alias(v) for v in values])


def positional_pairs(pred: DataFrame, truth: DataFrame, by: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs, counts). pairs: by, ordinal and the rows of both sides as structs p and t, the k-th of one with the k-th of
    the other inside each group of ``by``, in ``order``; what one side has more is cut off. counts: (by, n_pred, n_true, n_evaluated)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    side = lambda df, name: df.select(*by, place.alias("ordinal"), F.struct(*[F.col(c) for c in df.columns if c not in by]).alias(name))
    p, t = side(pred, "p"), side(truth, "t")
    both = p.join(t, [*by, "ordinal"], "full")
    counts = both.groupBy(*by).agg(F.count("p").alias("n_pred"), F.count("t").alias("n_true"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("n_evaluated"))
    return both.where("p IS NOT NULL AND t IS NOT NULL"), counts


def file_metrics(pred: DataFrame, truth: DataFrame, file: str, conv: str) -> tuple[DataFrame, DataFrame]:
    """M3, M4: (metrics by file and dimension, counts by file) of files of predictions and truth, both (file, conv, turn,
    pos, name, arguments): the k-th conversation of a predicted file against the k-th of the true one, as far as the shorter goes."""
    convs = lambda df: df.select(file, conv).distinct()
    pairs, counts = positional_pairs(convs(pred), convs(truth), [file], [conv])
    ids = pairs.select(file, "ordinal", F.col(f"p.{conv}").alias("_p"), F.col(f"t.{conv}").alias("_t"))
    side = lambda df, own: df.withColumnRenamed(conv, own).join(ids.select(file, own, "ordinal"), [file, own]).select(file, F.struct(file, "ordinal").alias("conv_id"), "turn", "pos", "name", "arguments")
    metrics = turn_metrics(match_calls(side(pred, "_p"), side(truth, "_t")))
    return dimension_metrics(metrics.withColumn(file, F.col(f"conv_id.{file}")), [file]), counts


def weighted_dimensions(per_file: DataFrame) -> DataFrame:
    """(dimension, n, metrics): means over files weighted by their turns or conversations."""
    values = ["strict_precision", "flexible_precision", "strict_accuracy"]
    mean = lambda v: F.round(F.coalesce(F.try_divide(F.sum(F.col(v) * F.col("n")), F.sum("n")), F.lit(0.0)), 5).alias(v)
    return per_file.groupBy("dimension").agg(F.sum("n").cast("bigint").alias("n"), *[mean(v) for v in values])


# Words too common to tie a call to an earlier result.
GENERIC = [
    "query", "search", "data", "info", "result", "value", "item", "list", "table",
    "user", "users", "name", "type", "status", "active", "total", "count", "number",
    "title", "description", "content", "text", "message", "error", "success",
    "true", "false", "null", "none", "yes", "no",
    "educational", "education", "learning", "student", "students", "teacher", "course",
    "book", "books", "design", "layout", "theme", "app", "application", "product",
    "technology", "tech", "digital", "online", "interactive", "modern", "new",
    "post", "comment", "comments", "feedback", "engagement", "market", "analysis",
    "bundle", "bundles", "nft", "asset", "assets", "sale", "price", "available",
]
# How values are mined from a result, each with the group it takes.
MINED = [
    (r"\b(?:[a-zA-Z]*_)?(?:0x)?[a-zA-Z0-9]*\d+[a-zA-Z0-9]*\b", 0),
    (r'"([^"]+)"', 1),
    (r":\s*([a-zA-Z0-9_\-\.\s]+?)(?:[,<]|\n|$)", 1),
    (r"<item>([^<]+)</item>", 1),
    (r"<cell>([^<]+)</cell>", 1),
    (r"(?i)(?:Author|Title|Name|ID|Code|Key|Value|Item)\s*:\s*([a-zA-Z0-9_\-\.\s]+?)(?:[,;]|\n|$)", 1),
]


def mined_values(result: Column) -> Column:
    """The values a result offers to later calls, in lower case: identifiers, quoted texts, values after a colon
    and the contents of items and cells, cut at commas; only those of at least 3 characters that are not
    generic and have a digit, one of _ - . or more than 8 characters."""
    text = F.coalesce(result, F.lit(""))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in MINED])
    after_colon = F.transform(found, lambda v: F.when(v.contains(":"), F.regexp_replace(F.lower(v), r"^[^:]*:", "")).otherwise(F.lower(v)))
    parts = F.transform(F.flatten(F.transform(after_colon, lambda v: F.split(v, ","))), lambda v: tx.strip(v))
    return F.array_distinct(F.filter(parts, lambda v: (F.length(v) >= 3) & ~v.isin(GENERIC) & (v.rlike(r"[0-9_.\-]") | (F.length(v) > 8))))


def call_links(calls: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, value): values of a call's arguments that come from the result of an earlier call
    of the turn. ``calls`` has conv_id, turn, pos, arguments (array<string>), result and query.

    A value counts if it has at least 3 characters, is not generic, is specific, is not part of the query and is
    equal to, part of or holds a value mined from an earlier result. The earlier results of a turn are a window over it,
    so a turn is shuffled once and no calls are joined.
    """
    earlier = Window.partitionBy("conv_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = calls.select("conv_id", "turn", "pos", "query", "arguments", mined_values(F.col("result")).alias("_m"))
    rows = rows.select("conv_id", "turn", "pos", "query", "arguments", F.array_distinct(F.flatten(F.collect_list("_m").over(earlier))).alias("_m")).where(F.size("_m") > 0)
    values = rows.select("conv_id", "turn", "pos", "query", "_m", F.explode("arguments").alias("_v")).withColumn("value", F.lower(tx.strip(F.col("_v"))))
    fit = (F.length("value") >= 3) & ~F.col("value").isin(GENERIC) & tx.specific(F.col("value")) & ~F.contains(F.lower(F.coalesce("query", F.lit(""))), F.col("value"))
    said = F.exists("_m", lambda m: F.contains(m, F.col("value")) | F.contains(F.col("value"), m))
    return values.where(fit).where(said).select("conv_id", "turn", "pos", "value").distinct()


def output_links(calls: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, value): values of a call's arguments, of 3 characters or more, that are not part of
    the query and are part of the output of an earlier call of the turn, or hold all of it. Null outputs count as {}."""
    earlier = Window.partitionBy("conv_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = calls.select("conv_id", "turn", "pos", "query", "arguments", F.collect_list(F.lower(F.coalesce("result", F.lit("{}")))).over(earlier).alias("_o"))
    values = rows.where(F.size("_o") > 0).select("conv_id", "turn", "pos", "query", "_o", F.explode("arguments").alias("_v")).withColumn("value", tx.strip(F.lower("_v")))
    fit = (F.length("value") >= 3) & ~F.contains(F.lower(F.coalesce("query", F.lit(""))), F.col("value"))
    said = F.exists("_o", lambda o: F.contains(o, F.col("value")) | F.contains(F.col("value"), o))
    return values.where(fit).where(said).select("conv_id", "turn", "pos", "value").distinct()


def strategies(calls: DataFrame, declared: str | None = None) -> DataFrame:
    """(conv_id, turn, strategy, n_calls): serial where a call uses an earlier result, else parallel, also for
    turns of one call. Without ``declared`` by ``call_links``; with it that label of the turn goes first, mixed counting
    as serial, and turns without one are judged by ``output_links``."""
    linked = (output_links(calls) if declared else call_links(calls)).select("conv_id", "turn").distinct().withColumn("_s", F.lit(True))
    label = F.first(F.nullif(F.lower(tx.strip(F.col(declared))), F.lit("")), ignorenulls=True) if declared else F.lit(None).cast("string")
    by = calls.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_calls"), label.alias("_d")).join(linked, ["conv_id", "turn"], "left")
    said = F.when(F.col("_d") == "mixed", "serial").when(F.col("_d").isin("serial", "parallel"), F.col("_d"))
    found = F.when(F.coalesce("_s", F.lit(False)), "serial").otherwise("parallel")
    return by.select("conv_id", "turn", F.coalesce(said, found).alias("strategy"), "n_calls")


def file_status(files: DataFrame) -> DataFrame:
    """(status, n) of files (file, n_pred, n_true): missing, empty, short, long or complete."""
    status = F.when(F.col("n_pred").isNull(), "missing").when(F.col("n_pred") == 0, "empty").when(F.col("n_pred") < F.col("n_true"), "short").when(F.col("n_pred") > F.col("n_true"), "long").otherwise("complete")
    return files.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def subset_metrics(metrics: DataFrame, strategy: DataFrame, most: int = 10, seed: str = "42") -> DataFrame:
    """M5: (subset, dimension, n, metrics) over the turns of more than one call: all of them, the serial ones, the
    parallel ones, and for N from 1 to ``most`` a serial to parallel mix of 1 to N drawn by hash.

    A turn's number of subsets is bounded by ``most``, so the membership is one explode, not a pass for each.
    """
    turns = metrics.join(strategy.where("n_calls > 1"), ["conv_id", "turn"])
    order = F.md5(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.lit(seed)))
    serial, parallel = turns.agg(F.count_if(F.col("strategy") == "serial"), F.count_if(F.col("strategy") == "parallel")).first()
    ranked = hash_rank(turns, ["strategy"], order, ["conv_id", "turn"])
    size = {n: min(serial, parallel // n) for n in range(1, most + 1)}
    inside = lambda n: F.col("_r") <= F.when(F.col("strategy") == "serial", size[n]).otherwise(n * size[n])
    member = [F.lit("all"), F.col("strategy"), *[F.when(inside(n), F.lit(f"1:{n}")) for n in range(1, most + 1)]]
    rows = ranked.select("conv_id", "turn", "n_pred", "n_true", "strict_precision", "flexible_precision", "strict_accuracy", F.explode(F.array_compact(F.array(*member))).alias("subset"))
    return dimension_metrics(rows, ["subset"])
