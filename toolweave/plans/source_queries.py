"""File sources and sinks on the tables: written into the shared folder, read back and compared with the tables themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from toolweave.operators import scoring as sc
from toolweave.plans.base import MSG_SQL, REC_SQL, TOOL_SQL, messages, records, tools
from toolweave.plans.evaluation_queries import _GATE, scores
from toolweave.operators.converters import grouped_records
from toolweave.plans.settle import shared_dir
from toolweave.sources import files
from toolweave.sources.tables import table


def _place(s, name: str) -> str:
    return f"{shared_dir(s)}/sources/{uuid.uuid4().hex}/{name}"


def _lines(s, d):
    """Feeds as files of lines, of which the unreadable ones are dropped."""
    at = _place(s, "lines.jsonl")
    table(s, d, "toolset_files").select("raw").write.text(at)
    read = files.tolerant_lines(s, at)
    return read.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("chars"))


def _columnar(s, d):
    """One table as ORC, CSV and JSON lines."""
    rows = table(s, d, "nation")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    orc, csv, lines = (_place(s, f"nation.{kind}") for kind in ("orc", "csv", "jsonl"))
    rows.write.orc(orc)
    files.write_csv(rows, csv)
    files.write_json(rows, lines)
    read = [files.columnar(s, at, schema).select(F.lit(kind).alias("kind"), "n_nationkey", "n_name", "n_regionkey") for kind, at in (("csv", csv), ("jsonl", lines), ("orc", orc))]
    return read[0].unionByName(read[1]).unionByName(read[2])


def _training(s, d):
    """The training export written as JSON lines and read back."""
    at = _place(s, "train.jsonl")
    made = grouped_records(messages(s, d), records(s, d)).withColumn("source_file", F.lit("f")).withColumn("row_idx", F.col("conv_id"))
    files.write_training(made, at)
    return s.read.schema(files.CONVERSATION).json(at).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("conversations")).alias("messages"))


def _manifest(s, d):
    gate = sc.quality_gate(sc.scored(scores(s, d)))
    return files.manifest(gate.where("passed"), gate.where("NOT passed"), "scores")


def _caches(s, d):
    """A cache per source file; every fifth entry has no vector."""
    rows = tools(s, d).select("source_file", F.col("description").alias("text"), F.when(F.col("tool_id") % 5 > 0, F.array(F.length("source_file").cast("double"))).otherwise(F.array().cast("array<double>")).alias("embedding"))
    return files.merged_cache(rows).select(F.md5("text").alias("h"), F.col("embedding")[0].alias("value"))


QUERIES = {
    "source_lines": (_lines, "SELECT count(*) AS n, sum(length(raw))::BIGINT AS chars FROM toolset_files WHERE json_valid(raw)"),
    "source_columnar": (_columnar, "SELECT kind, n_nationkey, n_name, n_regionkey FROM nation, (SELECT unnest(['csv', 'jsonl', 'orc']) AS kind)"),
    "source_training": (_training, f"WITH {MSG_SQL}, {REC_SQL} SELECT count(DISTINCT conv_id) AS n, count(*) AS messages FROM msg WHERE conv_id IN (SELECT conv_id FROM rec)"),
    "run_manifest": (_manifest, f"WITH {_GATE} SELECT 'scores' AS stage, count(*) FILTER (reason = 'ok') AS n_passed, count(*) FILTER (reason <> 'ok') AS n_failed FROM gate"),
    "merged_caches": (_caches, f"WITH {TOOL_SQL} SELECT md5(description) AS h, arg_min(length(source_file)::DOUBLE, source_file) AS value FROM tool WHERE description IS NOT NULL AND tool_id % 5 > 0 GROUP BY description"),
}
