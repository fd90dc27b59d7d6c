"""Sampling by hash order: reproducible, independent of partitions, and the same in any engine with md5."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toolweave.plans.settle import settle


def hash_order(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)))


def unit(key: str, seed: str) -> Column:
    """A number from 0 to 1 by the first 12 digits of the hash, neither end included."""
    return (F.conv(F.substring(hash_order(key, seed), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def hash_rank(df: DataFrame, group: list[str], order: Column, key: list[str]) -> DataFrame:
    """df + _r: the rank of each row in its group by a hexadecimal hash, ties by key, from 1.

    Groups are cut into 4096 slots by the first digits of the hash, counted, and ranked slot by slot, so a
    group that holds a third of all rows is spread over many tasks.
    """
    marked = df.withColumn("_h", order).withColumn("_slot", F.substring("_h", 1, 3))
    counts = marked.groupBy(*group, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_slot")) - F.col("_n")
    counts = counts.select(*group, "_slot", before.alias("_b"))
    rank = F.row_number().over(Window.partitionBy(*group, "_slot").orderBy("_h", *key))
    return marked.join(counts, [*group, "_slot"]).withColumn("_r", F.col("_b") + rank).drop("_h", "_slot", "_b")


def uniform(df: DataFrame, key: str, k: int, seed: str = "42") -> DataFrame:
    """K rows without replacement, the first by hash."""
    return df.orderBy(hash_order(key, seed), key).limit(k)


def weighted(df: DataFrame, key: str, weight: Column, k: int, seed: str = "42") -> DataFrame:
    """K rows drawn in turn with odds by weight: the k least exponential keys -ln(u) / w; weights of 0 or less are never drawn."""
    return df.withColumn("_w", weight).where("_w > 0").orderBy(-F.log(unit(key, seed)) / F.col("_w"), key).limit(k).drop("_w")


def proportional(df: DataFrame, stratum: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """About n rows, each stratum its share rounded down and at most its size; the last stratum by name
    takes the whole remainder (q23)."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.select(F.sum("_c").over(Window.partitionBy()).alias("_t"), "*")
    quota = F.least(F.floor(F.lit(n) * F.col("_c") / F.col("_t")), F.col("_c"))
    last = F.max(stratum).over(Window.partitionBy()) == F.col(stratum)
    quotas = total.withColumn("_last", last).withColumn("_q", F.when(F.col("_last"), 0).otherwise(quota))
    quotas = quotas.withColumn("_q", F.when(F.col("_last"), F.lit(n) - F.sum("_q").over(Window.partitionBy())).otherwise(F.col("_q"))).select(stratum, "_q")
    ranked = hash_rank(df, [stratum], hash_order(key, seed), [key])
    return ranked.join(quotas, stratum).where("_r <= _q").drop("_r", "_q")


def ratio_subset(df: DataFrame, label: str, a: str, b: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """S rows of label ``a`` and n * s of ``b``, s as great as both allow; by hash order."""
    x, y = df.agg(F.count_if(F.col(label) == a), F.count_if(F.col(label) == b)).first()
    size = min(x, y // n)
    rows = hash_rank(df.where(F.col(label).isin(a, b)), [label], hash_order(key, seed), [key])
    return rows.where(F.col("_r") <= F.when(F.col(label) == a, size).otherwise(n * size)).drop("_r")


def lock_value(df: DataFrame, label: str, least: int, seed: str = "42", tries: int = 20) -> DataFrame:
    """(label): of the first ``tries`` values by hash the first that ``least`` rows carry; no row where none does."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n")).orderBy(hash_order(label, seed), label).limit(tries)
    return sizes.where(F.col("_n") >= least).orderBy(hash_order(label, seed), label).limit(1).select(label)


def least_used(histogram: DataFrame, value: str, count: str, seed: str = "42") -> DataFrame:
    """(value): one with the least count, ties by hash."""
    return histogram.agg(F.min_by(value, F.struct(F.col(count), hash_order(value, seed), F.col(value))).alias(value))


def under_represented(histogram: DataFrame, value: str, count: str) -> DataFrame:
    """(value): the one with the least count, null when all counts are equal."""
    least = F.min_by(value, F.struct(F.col(count), F.col(value)))
    return histogram.agg(F.when(F.min(count) < F.max(count), least).alias(value))


def categorical(weights: DataFrame, value: str, weight: str, draws: DataFrame, seed: str = "42") -> DataFrame:
    """(draw, value): one value per row of ``draws`` (draw), with odds by weight: the first whose cumulative share reaches u(draw)."""
    cumulative = F.sum(weight).over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(Window.partitionBy())
    steps = weights.select(value, cumulative.alias("_c"))
    # The label space is small: one array of steps for all draws.
    table = steps.agg(F.array_sort(F.collect_list(F.struct(F.col("_c"), F.col(value).alias("v")))).alias("_t"))
    return draws.withColumn("_u", unit("draw", seed)).join(F.broadcast(table)).select("draw", F.get(F.filter("_t", lambda s: s["_c"] > F.col("_u")), F.lit(0))["v"].alias(value))


def episode_tools(usage: DataFrame, key: str, count: str, domain: str | None = None, lock: str | None = None, size: int = 10, most: int = 6, least: int = 4, seed: str = "42") -> DataFrame:
    """(key, source): up to ``most`` of the most used tools, up to ``least`` of the least used of the rest, the rest by hash.

    With ``lock`` these come from that domain, and tools of other domains fill up by hash what it can't; a lock that no
    tool carries is none. Ties of use go by key. Only a few rows at each end are ever compared.
    """
    locked = usage.where(F.col(domain) == lock) if domain and lock is not None else usage
    held = locked is not usage and not locked.isEmpty()
    locked = locked if held else usage
    top = locked.orderBy(F.desc(count), key).limit(most).select(key, F.lit("most").alias("source"))
    # Of the most + least least used rows at most ``most`` are among the top, so enough remain.
    low = locked.orderBy(count, key).limit(most + least).join(F.broadcast(top.select(key)), key, "left_anti")
    low = low.orderBy(count, key).limit(least).select(key, F.lit("least").alias("source"))
    fill = locked.orderBy(hash_order(key, seed), key).limit(size).select(key, F.lit("random").alias("source"))
    parts = [top, low, fill]
    if held:
        others = usage.where(~F.col(domain).eqNullSafe(lock))
        parts.append(others.orderBy(hash_order(key, seed), key).limit(size).select(key, F.lit("outside").alias("source")))
    order = F.array_position(F.array(*[F.lit(x) for x in ("most", "least", "random", "outside")]), F.col("source"))
    once = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min_by("source", order).alias("source"), F.min(order).alias("_g"))
    return once.orderBy("_g", hash_order(key, seed), key).limit(size).select(key, "source")


def with_repeats(ids: DataFrame, key: str, n: int, seed: str = "42") -> DataFrame:
    """(ordinal, key): n ids in hash order, each once before any repeats."""
    total = max(1, ids.count())
    ranked = hash_rank(ids.select(key).withColumn("_all", F.lit(0)), ["_all"], hash_order(key, seed), [key])
    placed = ranked.select(key, (F.col("_r") - 1).alias("_r"), F.lit(total).alias("_n")).where(F.col("_r") < n)
    rounds = F.sequence(F.lit(0), F.floor((F.lit(n - 1) - F.col("_r")) / F.col("_n")).cast("int"))
    return placed.select(F.explode(rounds).alias("_k"), key, "_r", "_n").select((F.col("_k") * F.col("_n") + F.col("_r")).cast("bigint").alias("ordinal"), key)


def seeded(df: DataFrame, index: str, seed: int) -> DataFrame:
    """+ seed: the base seed plus the index, for any number of workers (q31)."""
    return df.withColumn("seed", F.col(index) + F.lit(seed))


def numbered(df: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """Df + id: consecutive numbers from ``first`` in the order of the columns, ties by the whole row's hash.

    Rows are range-partitioned by the order and counted by partition; a partition numbers its own rows after
    those of the partitions before it, so nothing is sorted in one task. Equal rows get different numbers.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys, F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]))
    placed = settle(placed.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "placed")
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    own = F.col("_m") - (F.col("_p").cast("bigint") * F.lit(1 << 33))
    return placed.join(F.broadcast(before), "_p").withColumn("id", F.col("_b") + own + F.lit(first)).drop("_p", "_m", "_b")
