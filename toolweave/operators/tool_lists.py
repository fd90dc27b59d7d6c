"""Tool containers in four layouts, brought to one row per element."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.functions import text as tx


def elements(df: DataFrame, container: str, keep: list[str]) -> DataFrame:
    """S3: (keep, container_kind, container_key, tool_pos, raw) for each element of a container column.

    Layouts: [x] (kind list), {"tools": [x]} and {server: [x]} (kind lists), {id: x} (kind tools). tool_pos
    counts all elements in reading order, those that are no tools too. Null, blank and unreadable
    containers have no rows. The JSON stays in the JVM.
    """
    text = F.col(container)
    listed = F.from_json(text, "array<string>")
    opened = F.from_json(text, "map<string,string>")
    is_list, is_object = text.rlike(r"^\s*\["), text.rlike(r"^\s*\{")
    value = lambda e: e["value"]
    parts = F.when(
        is_list, F.transform(listed, lambda x: F.struct(F.lit("list").alias("kind"), F.lit(None).cast("string").alias("key"), x.alias("raw")))
    ).when(
        is_object,
        F.flatten(F.transform(F.map_entries(opened), lambda e: F.when(
            value(e).rlike(r"^\s*\["),
            F.transform(F.coalesce(F.from_json(value(e), "array<string>"), F.array()), lambda x: F.struct(F.lit("lists").alias("kind"), e["key"].alias("key"), x.alias("raw"))),
        ).otherwise(F.array(F.struct(F.lit("tools").alias("kind"), e["key"].alias("key"), value(e).alias("raw")))))),
    )
    out = df.select(*keep, F.posexplode(parts).alias("tool_pos", "_e"))
    return out.select(*keep, F.col("_e.kind").alias("container_kind"), F.col("_e.key").alias("container_key"), "tool_pos", F.col("_e.raw").alias("raw"))


def field(raw: Column, *names: str) -> Column:
    """The first of the members that is neither null nor ''."""
    return tx.first_filled(*[F.get_json_object(raw, f"$.{n}") for n in names])


def listed_tools(records: DataFrame) -> DataFrame:
    """(conv_id, tool_pos, name, description, category, domain, schema) of the tool objects of all records."""
    rows = elements(records, "tools", ["conv_id"]).where(F.col("raw").rlike(r"^\s*\{"))
    raw = F.col("raw")
    return rows.select(
        "conv_id", "tool_pos", field(raw, "name", "tool_name").alias("name"), F.get_json_object(raw, "$.description").alias("description"),
        field(raw, "category", "Category").alias("category"), field(raw, "domain", "Domain").alias("domain"), field(raw, "inputSchema", "input_schema", "parameters").alias("schema"),
    )
