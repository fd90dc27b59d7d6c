"""The pN_ queries of this subpackage, over the whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from toolweave.llm import ballhash, language, leaks, mix, packing, pairs, spans, tokens
from toolweave.plans.settle import settle
from toolweave.sources.tables import table, without_redelivery


def _alike(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "toolset").where(F.length("description") >= 40)
    words = F.concat_ws(" ", F.coalesce("name", "tool_name", F.lit("")), "description")
    similar, members = ballhash.similar_pairs(rows, "tool_id", ballhash.normal_text(words), 0.7, F.col("loaded_at"))
    return settle(similar, "pairs"), members


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballhash.member_pairs(*_alike(spark, sf_dir), "tool_id")


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ballhash.class_links(*_alike(spark, sf_dir), "tool_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "bench_items").select("item_id", "text")
    said = leaks.leaked_items(items, "item_id", "text", table(spark, sf_dir, "format_messages"), "conv_id", "value")
    listed = leaks.leaked_items(items, "item_id", "text", table(spark, sf_dir, "format_records"), "conv_id", "tools", nested=True)
    return said.unionByName(listed).distinct()


PAIR = ["category", "domain"]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps of the plan that the supply leaves: target_share * floor(number of tools / 5) or min_rows above what is there."""
    return p5_plan(spark, sf_dir).where("gap < 0 AND (available < wanted OR available < least)").select(*PAIR)


def p5_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.plan(table(spark, sf_dir, "toolset"), "tool_id", PAIR, table(spark, sf_dir, "mix_targets"), "target_share", "min_rows", 0.2)


def p5_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.margins(p5_plan(spark, sf_dir), PAIR)


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.draw(table(spark, sf_dir, "toolset"), "tool_id", PAIR, p5_plan(spark, sf_dir))


P5_SQL = r"""
WITH tools AS (SELECT DISTINCT tool_id, lower(regexp_replace(category, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS category,
                      lower(regexp_replace(domain, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS domain FROM toolset),
n AS (SELECT floor(count(DISTINCT tool_id) / 5) AS size FROM tools),
c AS (SELECT category, domain, count(DISTINCT tool_id) AS available FROM tools GROUP BY ALL)
SELECT m.category, m.domain FROM mix_targets m LEFT JOIN c USING (category, domain), n
WHERE coalesce(available, 0) < target_share * size OR coalesce(available, 0) < min_rows
"""


def _spoken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tools = table(spark, sf_dir, "toolset").select("tool_id", "description", "lang", "loaded_at")
    messages = table(spark, sf_dir, "format_messages").where(F.col("role").isin("human", "gpt", "assistant"))
    return tools, messages.select("conv_id", "pos", "role", "value", "lang", "loaded_at")


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools, messages = _spoken(spark, sf_dir)
    model = language.learn([(tools, "description", "lang"), (messages, "value", "lang")])
    a = language.segments(without_redelivery(tools, ["tool_id"]), ["tool_id"], "description", "lang", model)
    b = language.segments(without_redelivery(messages, ["conv_id", "pos"]), ["conv_id", "pos"], "value", "lang", model)
    rest = ["seg", "lang", "confidence", "declared", "n_seg", "start", "end"]
    return a.select(F.lit("toolset").alias("rec_kind"), F.col("tool_id").alias("rec_id"), F.lit(-1).alias("pos"), *rest).unionByName(
        b.select(F.lit("message").alias("rec_kind"), F.col("conv_id").alias("rec_id"), "pos", *rest)
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p6_segments(spark, sf_dir).where("n_seg > 1 OR declared IS NULL OR declared <> lang")
    return found.select("rec_kind", "rec_id", "pos", "seg", "lang")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools, messages = _spoken(spark, sf_dir)
    model = language.learn([(tools, "description", "lang"), (messages, "value", "lang")])
    once = without_redelivery(messages, ["conv_id", "pos"])
    return pairs.defects(pairs.chat_pairs(once, "conv_id", "pos", "role", "value"), ["conv_id", "pos"], model)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.pack(counts, "doc_id", "n_tokens", 2048)


def _shared(spark: SparkSession, sf_dir: str) -> spans.Shared:
    return spans.search(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.found_pairs(_shared(spark, sf_dir))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(_shared(spark, sf_dir))


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.links_by_class(_shared(spark, sf_dir))


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text")[0]


def p10_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.removals(spans.paragraph_clusters(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_classes": p1_classes, "p4_found": p4_found, "p5_found": p5_found, "p5_plan": p5_plan, "p5_margins": p5_margins, "p5_sample": p5_sample, "p6_found": p6_found, "p6_segments": p6_segments, "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_share": p10_share, "p10_classes": p10_classes, "p10_spans": p10_spans, "p10_removals": p10_removals}


def oracle_sql() -> dict[str, str]:
    return {"p5_found": P5_SQL}
