"""The same operators on streams of messages and calls (ST1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def parquet_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files: int | None = None) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def timed(stream: DataFrame, at: str) -> DataFrame:
    """The event time as a timestamp with zone, which watermarks need."""
    return stream.withColumn(at, F.col(at).cast("timestamp"))


def once(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen within the watermark: re-delivered rows are dropped with bounded state."""
    return timed(stream, at).withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, by: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Tumbling or sliding counts: (window_start, window_end, by, n); rows later than the watermark are dropped."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    counts = timed(stream, at).withWatermark(at, late).groupBy(window.alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *by, "n")


def sessions(stream: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a key: (key, session_start, session_end, n)."""
    grouped = timed(stream, at).withWatermark(at, late).groupBy(F.session_window(at, gap).alias("_w"), key).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("_w.start").alias("session_start"), F.col("_w.end").alias("session_end"), "n")


def running_usage(stream: DataFrame, name: str) -> DataFrame:
    """(name, n, batches): the running number of calls of each tool, kept as state across batches."""

    def add(key, parts, state: GroupState):
        n, batches = state.get if state.exists else (0, 0)
        import pandas as pd

        n, batches = n + sum(len(p) for p in parts), batches + 1
        state.update((n, batches))
        yield pd.DataFrame({"name": [key[0]], "n": [n], "batches": [batches]})

    rows = stream.select(F.col(name).alias("name")).where("name IS NOT NULL")
    return rows.groupBy("name").applyInPandasWithState(add, "name string, n bigint, batches bigint", "n bigint, batches bigint", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, place: str) -> DataFrame:
    """Run a stream over what is there now into Parquet below ``place``, a folder that all machines share.

    Each batch replaces its own folder, so one that is run again after a failure is written once. With mode complete
    the last batch holds the result; with update each row is the state after its batch, numbered by ``batch``.
    """
    kept = f"{place}/batches"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{kept}/batch={number}")

    started = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
    started.awaitTermination()
    spark = stream.sparkSession
    number = (started.lastProgress or {}).get("batchId", -1)
    if number < 0:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{kept}/batch={number}")
    return spark.read.schema(stream.schema).option("basePath", kept).parquet(kept)


def append_to(stream: DataFrame, path: str, checkpoint: str):
    """Append-only Parquet output that resumes from its checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
