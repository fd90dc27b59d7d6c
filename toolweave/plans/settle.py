"""Tables written to the cluster's shared folder, to cut lineage and to read a costly result twice."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a folder of our own if the master is
    one process (tests); on a cluster that is an error, as each machine would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="toolweave-")
    return _own_dir[app]


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df once as Parquet into the shared folder and return it read back: the plan is computed
    once, survives the loss of executors, and readers keep column pruning and filters."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = hadoop(path)
        where.getFileSystem(conf).delete(where, True)


def drop(*settled: DataFrame) -> None:
    """Delete settled tables that no later plan reads: those of finished steps inside an operator."""
    for df in settled:
        spark = df.sparkSession
        own = _written.get(spark.sparkContext.applicationId, [])
        names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        gone = [p for p in own if p.rsplit("/", 1)[-1] in names]
        _written[spark.sparkContext.applicationId] = [p for p in own if p not in gone]
        _delete(spark, gone)


def release(spark: SparkSession) -> int:
    """Delete the tables this application has settled so far; call it once their results are written. Returns how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)
