"""The pN_ queries of the core: nested records (2) and drifting schemas (3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolweave.operators import drift, shred
from toolweave.sources.tables import table, without_redelivery

ATTRIBUTES = ["type", "param_type", "description", "default", "required", "minimum"]


def _params(spark: SparkSession, sf_dir: str, attributes: list[str]) -> DataFrame:
    tools = without_redelivery(table(spark, sf_dir, "toolset").select("tool_id", "input_schema", "loaded_at"), ["tool_id"])
    records = without_redelivery(table(spark, sf_dir, "format_records").select("conv_id", "tools", "loaded_at"), ["conv_id"])
    a = shred.parameter_table(tools, "tool_id", "input_schema", "schema", attributes).withColumn("rec_kind", F.lit("toolset"))
    b = shred.parameter_table(records, "conv_id", "tools", "tools", attributes).withColumn("rec_kind", F.lit("format"))
    return a.unionByName(b)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _params(spark, sf_dir, []).select("rec_kind", "rec_id", "tool_pos", "path", "parent_path")


def p2_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _params(spark, sf_dir, ATTRIBUTES).select("rec_kind", "rec_id", "tool_pos", "path", "parent_path", "name", "ordinal", *ATTRIBUTES)


def p2_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = without_redelivery(table(spark, sf_dir, "format_records").select("conv_id", "tools", "loaded_at"), ["conv_id"])
    return shred.tool_table(records, "conv_id", "tools", ["name", "description", "category", "domain"])


def p2_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = without_redelivery(table(spark, sf_dir, "toolset").select("tool_id", "input_schema", "loaded_at"), ["tool_id"])
    return shred.entities(shred.adjacency(tools, "tool_id", "input_schema"), "tool_id", ["name", "type", "description"])


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_redelivery(table(spark, sf_dir, "toolset_files"), ["feed", "file_seq", "row_no"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.changes(_files(spark, sf_dir), "feed", "file_seq", "file_name", "tool_key", "raw")
    return found.select("file_name", "change", "old_field", "new_field")


def p3_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    change = drift.changes(files, "feed", "file_seq", "file_name", "tool_key", "raw")
    rows = drift.unified(files, "feed", "file_seq", "row_no", "tool_key", "raw", change)
    return rows.select("feed", "seq", "row_no", "key", F.to_json("cells").alias("cells"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p2_found": p2_found, "p2_params": p2_params, "p2_tools": p2_tools, "p2_entities": p2_entities, "p3_found": p3_found, "p3_unified": p3_unified}


def oracle_sql() -> dict[str, str]:
    return {}
