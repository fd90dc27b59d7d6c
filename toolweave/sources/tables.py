"""Readers of the driver's tables, and the rule for re-delivered rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def delivered_once(df: DataFrame, keys: list[str], columns: list[str], at: str = "loaded_at") -> DataFrame:
    """One row per key, the earliest delivered; ties of the time go to the least row of ``columns``.

    Rows with a null key are kept as one row per null key. An empty table stays empty.
    """
    first = F.min(F.struct(F.col(at), *[F.col(c) for c in columns])).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in columns])


#: Keys delivered more than once that are marked in bits sent to every task; beyond it all rows are grouped.
MARKED_KEYS = 4_000_000


def first_deliveries(df: DataFrame, keys: list[str], columns: list[str], at: str = "loaded_at") -> DataFrame:
    """The rows of ``delivered_once``; those whose key stands once are not shuffled.

    The keys alone are counted. One that stands more than once sets the bit of its hash, of 32 bits a key at
    least. Rows with a set bit are grouped; a key that only shares the bit is a group of one row.
    """
    spark, key_hash = df.sparkSession, F.xxhash64(*keys)
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key_hash.alias("_hash"))
    found = twice.limit(MARKED_KEYS + 1).toArrow().column(0).to_numpy()
    if len(found) > MARKED_KEYS:
        return delivered_once(df, keys, columns, at)
    if not len(found):
        return df.select(*keys, *columns)
    words = 1 << (len(found) // 2).bit_length()
    mask = 64 * words - 1
    marks, at_bit = np.zeros(words, np.uint64), (found & mask).astype(np.uint64)
    np.bitwise_or.at(marks, at_bit >> np.uint64(6), np.uint64(1) << (at_bit & np.uint64(63)))
    # An array in a row of its own is read in place; a literal would be copied into every plan.
    sent = spark.createDataFrame(pa.table({"_marks": pa.array([marks.view(np.int64)], pa.list_(pa.int64()))}))
    bit = key_hash.bitwiseAND(F.lit(mask))
    marked = F.getbit(F.get("_marks", F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1
    rows = df.crossJoin(F.broadcast(sent))
    return rows.where(~marked).select(*keys, *columns).unionByName(delivered_once(rows.where(marked), keys, columns, at))


#: Keys delivered more than once that may be sent to every task; beyond it they are joined by shuffle.
SENT_KEYS = 100_000


def without_redelivery(df: DataFrame, keys: list[str], at: str = "loaded_at") -> DataFrame:
    """df with one row per key, the earliest delivered; of equal times the least row by its values.

    Only keys that stand more than once are ever grouped, so the wide columns of the others are not
    shuffled. The list of such keys is broadcast only while it is short. Map columns are compared by
    their sorted entries. Rows whose key has a null are kept as they are. An empty table stays empty.
    """
    key = F.struct(*keys)
    known = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    twice = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key.alias("_key"))
    few = twice.limit(SENT_KEYS + 1).count()
    if few == 0:
        return df
    named = df.withColumn("_key", key)
    twice = F.broadcast(twice) if few <= SENT_KEYS else twice
    single = named.join(twice, "_key", "left_anti").drop("_key")
    several = named.join(twice, "_key", "left_semi").drop("_key")
    plain = [f.name for f in df.schema.fields if f.dataType.typeName() != "map"]
    maps = [F.sort_array(F.map_entries(f.name)).alias(f.name) for f in df.schema.fields if f.dataType.typeName() == "map"]
    rest = [c for c in plain if c not in keys and c != at]
    picked = several.groupBy(*keys).agg(F.min(F.struct(F.col(at), *[F.col(c) for c in rest], *maps)).alias("_r"))
    columns = [F.col(c) if c in keys else F.map_from_entries(f"_r.{c}").alias(c) if c not in plain else F.col(f"_r.{c}").alias(c) for c in df.columns]
    return single.unionByName(picked.select(*columns))
