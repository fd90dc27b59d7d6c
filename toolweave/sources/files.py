"""File sources and sinks: conversation JSON, tool pools, tolerant JSON lines, Arrow, documents, reports."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONVERSATION = T.StructType([
    T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]))),
    T.StructField("system", T.StringType()), T.StructField("tools", T.StringType()), T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])
# Files beside the data that a directory scan leaves out.
LEFT_OUT = r"(\.bak2?$)|(^|/)\.|(_stats|_statistics|manifest)\.json$"


def with_source(df: DataFrame) -> DataFrame:
    """+ source_file: the name of the file each row came from."""
    return df.select("*", F.col("_metadata.file_name").alias("source_file"))


def listed_files(spark: SparkSession, folder: str, pattern: str = "*.json", recursive: bool = True) -> DataFrame:
    """(path, length, modified) of a folder's files without backups, hidden and statistics files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).where(~F.col("path").rlike(LEFT_OUT))


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, row_idx, conversations, system, tools, properties) of files that hold one list of records.

    A single object counts as a list of one; files of another form give no rows. row_idx is the place in the
    file. tools stays text: an array in the file is kept as its JSON.
    """
    whole = spark.read.text(path, wholetext=True)
    rows = with_source(whole)
    text = F.trim("value")
    array = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.startswith("{"), F.array(text))
    items = rows.select("source_file", F.posexplode(array).alias("row_idx", "_raw"))
    parsed = items.withColumn("_r", F.from_json("_raw", CONVERSATION))
    return parsed.where("_r IS NOT NULL").select("source_file", F.col("row_idx").cast("bigint").alias("row_idx"), "_r.*")


def messages(records: DataFrame) -> DataFrame:
    """(source_file, row_idx, pos, role, value) of conversation records."""
    out = records.select("source_file", "row_idx", F.posexplode("conversations").alias("pos", "_m"))
    return out.select("source_file", "row_idx", "pos", F.col("_m.from").alias("role"), F.col("_m.value").alias("value"))


def tool_pools(spark: SparkSession, path: str) -> DataFrame:
    """S3: (source_file, container) of tool files in any of the four layouts; open it with tool_lists.elements."""
    return with_source(spark.read.text(path, wholetext=True)).select("source_file", F.col("value").alias("container"))


def tolerant_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, raw) of the lines that are JSON; others are dropped."""
    return with_source(spark.read.text(path)).where(F.try_parse_json("value").isNotNull()).select("source_file", F.col("value").alias("raw"))


def arrow_files(spark: SparkSession, path: str, schema: str, pattern: str = "*.arrow") -> DataFrame:
    """Rows of Arrow stream or file containers; the columns of ``schema`` are taken by name. Each file is
    read by the task that lists it, batch by batch."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("content")
    names = [f.name for f in T.StructType.fromDDL(schema).fields] if hasattr(T.StructType, "fromDDL") else [x.strip().split()[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                buffer = blob.as_buffer()
                try:
                    reader = pa.ipc.open_file(buffer)
                    parts = (reader.get_batch(i) for i in range(reader.num_record_batches))
                except pa.ArrowInvalid:
                    parts = iter(pa.ipc.open_stream(buffer))
                for part in parts:
                    yield part.select(names)

    return files.mapInArrow(run, schema)


def columnar(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet or, by the suffix, ORC, CSV, JSON lines or Arrow."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "arrow":
        return arrow_files(spark, path, schema or "")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.option("header", True).csv(path)
    return reader.json(path) if kind in ("json", "jsonl") else reader.orc(path) if kind == "orc" else reader.parquet(path)


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """(episode, raw) of files episode_0001.json and so on."""
    rows = with_source(spark.read.text(path, wholetext=True))
    number = F.regexp_extract("source_file", r"^episode_(\d{4})\.json$", 1)
    return rows.where(number != "").select(number.cast("int").alias("episode"), F.col("value").alias("raw"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, text) of whole documents."""
    return with_source(spark.read.text(path, wholetext=True)).select("source_file", F.col("value").alias("text"))


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; Spark's commit protocol renames whole outputs, so a reader sees the old or the new."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_training(records: DataFrame, path: str, sample: int = 10) -> DataFrame:
    """The conversations, system and tools of records as JSON lines; returns the first ``sample`` records by file and place."""
    rows = records.select("source_file", "row_idx", "conversations", "system", "tools")
    write_json(rows.drop("source_file", "row_idx"), path)
    return rows.orderBy("source_file", "row_idx").limit(sample)


def write_csv(df: DataFrame, path: str) -> None:
    """S10."""
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small aggregate as a Markdown table; a table of more than ``most`` rows is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write a table instead of a report")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def manifest(passed: DataFrame, failed: DataFrame, stage: str) -> DataFrame:
    """(stage, n_passed, n_failed)."""
    flags = passed.select(F.lit(1).alias("ok")).unionByName(failed.select(F.lit(0).alias("ok")))
    return flags.agg(F.count_if(F.col("ok") == 1).alias("n_passed"), F.count_if(F.col("ok") == 0).alias("n_failed")).select(F.lit(stage).alias("stage"), "n_passed", "n_failed")


def merged_cache(caches: DataFrame) -> DataFrame:
    """(text, embedding) of per-file caches (source_file, text, embedding): the first file's entry of each
    text; entries without a vector are dropped."""
    good = caches.where(F.col("text").isNotNull() & (F.size("embedding") > 0))
    return good.groupBy("text").agg(F.min_by("embedding", "source_file").alias("embedding"))
