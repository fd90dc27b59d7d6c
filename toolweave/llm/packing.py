"""Filling containers of fixed capacity by minimum bin slack (problem 9)."""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.plans.settle import settle

#: Pieces packed together by one task; the last container of each such block may stay part empty.
BLOCK_ROWS = 20_000


def fill_container(left: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """(length, count) of the remaining lengths whose sum is closest to ``room`` from below.

    ``lengths`` holds the remaining lengths in descending order. Bit b of the set says that some
    choice of the lengths seen so far has the sum b; counts enter in powers of two. The walk ends
    when the bit of ``room`` is set. Going back, the earliest step that has the wanted bit tells
    which lengths made it.
    """
    mask = (1 << (room + 1)) - 1
    reach, full = 1, 1 << room
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room or length == 0:
            continue
        count, part = min(left[length], room // length), 1
        while count > 0 and not reach & full:
            part = min(part, count)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            count -= part
            part *= 2
        if reach & full:
            break
    want, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, part, before in reversed(steps):
        if not (before >> want) & 1:
            chosen[length] += part
            want -= length * part
    return list(chosen.items())


def pack_block(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Container and place of each item; the longest remaining item opens each container.

    Items of size 0 take no room and lie in the first container.
    """
    container, place = [0] * len(sizes), [0] * len(sizes)
    of: dict[int, list[int]] = defaultdict(list)
    for i in sorted(range(len(sizes)), key=lambda i: -i):
        of[sizes[i]].append(i)
    left = {size: len(items) for size, items in of.items() if size > 0}
    lengths = sorted(left, reverse=True)
    number = 0
    while lengths:
        first = lengths[0]
        left[first] -= 1
        picked = [(first, 1), *fill_container(left, lengths, capacity - first)]
        at = 0
        for k, (length, count) in enumerate(picked):
            if k:
                left[length] -= count
            for _ in range(count):
                i = of[length].pop()
                container[i], place[i] = number, at
                at += 1
        if any(left[length] == 0 for length, _ in picked):
            lengths = [x for x in lengths if left[x]]
        number += 1
    for at, i in enumerate(reversed(of.get(0, [])), start=sum(1 for c, s in zip(container, sizes, strict=True) if c == 0 and s > 0)):
        place[i] = at
    return container, place


def pack(df: DataFrame, key: str, size: str, capacity: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(container bigint, place int, key, piece int, n_tokens int): where each item, or piece of it, lies.

    Only an item larger than the capacity is split: into pieces of the whole capacity and a rest, in
    order. Pieces are dealt by hash into blocks of about ``block_rows``, so no task grows with the
    table and one huge item spreads too; each block is packed by itself. A null size counts as 0.
    Repeated rows are packed as often as they stand; an empty table gives none. The result depends
    only on the rows, not on their order.
    """
    items = settle(df.select(F.col(key).alias("_key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size")), "sizes")
    whole = F.greatest(F.ceil(F.col("_size") / capacity), F.lit(1)).cast("int")
    pieces = items.select("_key", "_size", F.explode(F.sequence(F.lit(0), whole - 1)).alias("_piece")).select(
        "_key", F.col("_piece").cast("int").alias("_piece"), F.least(F.lit(capacity), F.col("_size") - F.col("_piece").cast("bigint") * capacity).cast("int").alias("_n")
    )
    total = items.agg(F.coalesce(F.sum(whole.cast("bigint")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(total) // block_rows))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("_key", "_piece"), F.lit(blocks)))
    kind = df.schema[key].dataType.simpleString()

    def run(block, got):
        got = got.sort_by([("_n", "descending"), ("_key", "ascending"), ("_piece", "ascending")])
        container, place = pack_block(got.column("_n").to_pylist(), capacity)
        base = block[0].as_py() << 32
        return pa.table({
            "container": pa.array([base + c for c in container], pa.int64()), "place": pa.array(place, pa.int32()),
            key: got.column("_key"), "piece": got.column("_piece"), "n_tokens": got.column("_n"),
        })

    return dealt.groupBy("_block").applyInArrow(run, f"container bigint, place int, `{key}` {kind}, piece int, n_tokens int")
