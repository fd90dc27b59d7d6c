"""Pairs inside groups and connected components, for groups and hubs of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.plans.settle import drop, settle

#: Members of one block of a group; a larger group is cut into blocks, and each two blocks meet in a task's cell.
BLOCK = 1024


def group_pairs(df: DataFrame, group: list[str], member: str, carried: list[str] = (), differ: Column | None = None, block: int = BLOCK) -> DataFrame:
    """(group, a, b, and for every carried column c: c_a, c_b), a < b: each two rows of a group with different members.

    A group of more than ``block`` rows is cut into blocks by a hash of its members, and every two blocks
    meet in a cell of their own, so no task gets more than two blocks of a group at a time. ``differ`` may
    restrict the pairs, by columns c_l and c_r. A member that stands several times in a group is paired
    each time. Null groups and null members have no pairs.
    """
    carried = list(carried)
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    large = large.select(*group, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    cut = df.select(*group, member, *[c for c in carried if c != member]).join(large, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    cut = cut.withColumn("_own", F.pmod(F.xxhash64(member, F.lit(17)), F.col("_blocks")).cast("int"))
    left = cut.select(*group, F.col(member).alias("_l"), *[F.col(c).alias(f"{c}_l") for c in carried], F.col("_own").alias("_i"), F.explode(F.expr("sequence(_own, _blocks - 1)")).alias("_j"))
    right = cut.select(*group, F.col(member).alias("_r"), *[F.col(c).alias(f"{c}_r") for c in carried], F.col("_own").alias("_j"), F.explode(F.expr("sequence(0, _own)")).alias("_i"))
    both = left.join(right, [*group, "_i", "_j"]).where("_l <> _r AND (_i <> _j OR _l < _r)")
    if differ is not None:
        both = both.where(differ)
    swap = F.col("_l") > F.col("_r")
    sides = [F.when(swap, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{s}") for c in carried for s, x, y in (("a", "l", "r"), ("b", "r", "l"))]
    return both.select(*group, F.least("_l", "_r").alias("a"), F.greatest("_l", "_r").alias("b"), *sides)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the links: its component's least node.

    Large and small stars in turn until nothing changes: each round halves the depth of the trees or so,
    whatever the shape of the graph. Nodes are only ever joined with the least of their neighbours, never
    gathered. Links with a null end are left out; a link of a node with itself gives the node alone.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = settle(ends.select("u").union(ends.select("v")).distinct().withColumnRenamed("u", "node"), "nodes")
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    edges = settle(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        last, edges = edges, settle(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        drop(last)
        after = state(edges)
        if after == before:
            break
        before = after
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
