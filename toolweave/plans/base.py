"""Input frames of the core's queries, and the same as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toolweave.sources.tables import delivered_once, table

MSG_SQL = """msg AS (SELECT conv_id, pos, role, value, source_file FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, pos ORDER BY loaded_at) AS rn FROM format_messages) WHERE rn = 1)"""
REC_SQL = """rec AS (SELECT conv_id, source_file, row_idx, system_prompt, tools, properties FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY loaded_at) AS rn FROM format_records) WHERE rn = 1)"""
TOOL_SQL = """tool AS (SELECT tool_id, server, source_file, coalesce(name, tool_name) AS name, description, category, domain, input_schema FROM (SELECT *, row_number() OVER (PARTITION BY tool_id ORDER BY loaded_at) AS rn FROM toolset) WHERE rn = 1)"""
TURN_SQL = MSG_SQL + """,
turned AS (SELECT *, count(*) FILTER (role = 'human') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS turn,
                  lead(role) OVER (PARTITION BY conv_id ORDER BY pos) AS nxt FROM msg),
hop AS (SELECT conv_id, turn, count(*) FILTER (role = 'function_call') AS n_calls FROM turned WHERE turn > 0 GROUP BY ALL)"""


LIST_SQL = REC_SQL + """,
jso AS (SELECT conv_id, CASE WHEN json_valid(tools) THEN tools::JSON END AS t FROM rec),
prt AS (SELECT conv_id, CASE json_type(t) WHEN 'ARRAY' THEN list_transform(json_extract(t, '$[*]'), lambda x: {'k': 'list', 'raw': x})
        WHEN 'OBJECT' THEN flatten(list_transform(json_keys(t), lambda k: CASE WHEN json_type(t, '$."' || k || '"') = 'ARRAY' THEN list_transform(json_extract(json_extract(t, '$."' || k || '"'), '$[*]'), lambda x: {'k': 'lists', 'raw': x}) ELSE [{'k': 'tools', 'raw': json_extract(t, '$."' || k || '"')}] END)) END AS e FROM jso),
els AS (SELECT conv_id, (i - 1)::INT AS tool_pos, e[i].k AS container_kind, e[i].raw AS raw FROM (SELECT conv_id, e, unnest(generate_series(1, len(e))) AS i FROM prt)),
lst AS (SELECT conv_id, tool_pos, coalesce(nullif(raw->>'$.name', ''), nullif(raw->>'$.tool_name', '')) AS name, raw->>'$.description' AS description,
        coalesce(nullif(raw->>'$.category', ''), nullif(raw->>'$.Category', '')) AS category, coalesce(nullif(raw->>'$.domain', ''), nullif(raw->>'$.Domain', '')) AS domain FROM els WHERE json_type(raw) = 'OBJECT')"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "format_messages")
    return delivered_once(rows, ["conv_id", "pos"], ["role", "value", "source_file"])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "format_records").withColumn("properties", F.array_sort(F.map_entries("properties")))
    once = delivered_once(rows, ["conv_id"], ["source_file", "row_idx", "system_prompt", "tools", "properties"])
    return once.withColumn("properties", F.map_from_entries("properties"))


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "toolset").withColumn("name", F.coalesce("name", "tool_name"))
    return delivered_once(rows, ["tool_id"], ["server", "source_file", "name", "description", "category", "domain", "input_schema"])
