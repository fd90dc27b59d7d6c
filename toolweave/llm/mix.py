"""A sample that matches target proportions of categories (problem 5).

The target shares are raked by iterative proportional fitting over their own margins, on the table of
cells, which has as many rows as there are targets: where a cell is short or below its minimum it is held
at that bound, and the others are fitted so that the margins of every label stay what the targets ask for,
as far as the supply allows. The quotas are the raked totals in whole numbers; records are then drawn by
weighted exponential keys, -ln(u) / w with u from a hash of the record's key, and the quotas of the cells
are met by the least keys of each. What can't be met is reported as the gap of its cell.

The draw sorts no cell: a histogram of the keys by cell gives the slot in which the quota ends, rows below
it are in, and only the rows of that one slot are ranked.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.plans.settle import settle

#: Slots of the keys' histogram; the ranked slot holds about a 4096th of a cell.
SLOTS = 4096
#: Cells of the targets that the driver will rake; more is refused.
MAX_CELLS = 200_000


def tidy(label: Column) -> Column:
    """A label without white space at its ends, in lower case."""
    return F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))


def availability(df: DataFrame, key: str, labels: list[str], targets: DataFrame, share: str, least: str, fraction: float) -> DataFrame:
    """(labels, share, least, available, wanted) per row of ``targets``: how many distinct keys carry the
    pair of labels, and how many the sample should have. Of a key with several labels each counts."""
    tools = df.select(key, *[tidy(F.col(c)).alias(c) for c in labels]).where(f"`{key}` IS NOT NULL").distinct()
    total = tools.agg(F.countDistinct(key)).first()[0]
    counted = tools.groupBy(*labels).agg(F.countDistinct(key).alias("available"))
    goal = targets.select(*labels, F.col(share).alias("share"), F.col(least).alias("least"))
    size = F.lit(math.floor(total * fraction)).cast("bigint")
    return goal.join(counted, labels, "left").select(*labels, "share", "least", F.coalesce("available", F.lit(0)).alias("available"), (F.col("share") * size).alias("wanted"), size.alias("size"))


def _factors(base: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """The factor of each group by which ``base``, cut to its bounds, comes to the group's ``goal`` or as near as it can."""
    under, over = np.zeros(len(goal)), np.zeros(len(goal))
    np.maximum.at(over, group, high / base)
    for _ in range(80):
        mid = (under + over) / 2
        less = np.bincount(group, np.clip(base * mid[group], low, high), len(goal)) < goal
        under, over = np.where(less, mid, under), np.where(less, over, mid)
    return over


def rake(counts: dict[tuple, float], margins: list[dict], low: dict[tuple, float] = {}, high: dict[tuple, float] = {}, rounds: int = 200, close: float = 1e-9) -> dict[tuple, float]:  # noqa: B006
    """Cell totals with the given margins (one per label) that keep the cells' own interactions, each within
    its bounds where it has any; a label that its cells can't fill leaves its rest to the other labels."""
    cells = [c for c, n in counts.items() if n > 0]
    whole = sum(margins[0].values()) if margins else 0.0
    if not cells or whole <= 0:
        return dict.fromkeys(cells, 0.0)
    base = np.array([float(counts[c]) for c in cells])
    base *= whole / base.sum()
    least = np.array([float(low.get(c, 0.0)) for c in cells])
    most = np.maximum(least, [min(float(high.get(c, whole)), whole) for c in cells])
    sides = []
    for k, margin in enumerate(margins):
        at = {label: i for i, label in enumerate(dict.fromkeys(c[k] for c in cells))}
        group = np.array([at[c[k]] for c in cells])
        goal = np.array([max(float(margin.get(label, 0.0)), 1e-12 * whole) for label in at])
        floor, roof = np.bincount(group, least, len(at)), np.bincount(group, most, len(at))
        same = np.zeros(len(at), dtype=np.int64)
        sides.append((group, np.clip(goal * _factors(goal, floor, roof, same, np.array([whole]))[0], floor, roof)))
    got = np.clip(base, least, most)
    for _ in range(rounds):
        before = got
        for group, goal in sides:
            factor = np.clip(_factors(base, least, most, group, goal), 1e-9, 1e9)
            base = np.clip(base * factor[group], 1e-100, 1e100)
            got = np.clip(base, least, most)
        if np.abs(got - before).max() < close * whole:
            break
    return dict(zip(cells, got.tolist(), strict=True))


def quotas(rows: list[dict], size: int, raked: list[float] | None = None) -> list[int]:
    """Whole numbers for the cells that sum to ``size`` where the supply allows.

    Each starts at its raked total, else at its share, by largest remainder, is cut at what is available and raised to its minimum;
    what is left over or short is then spread where it deviates least in proportion.
    """
    exact = [float(r["share"] or 0) * size for r in rows] if raked is None else raked
    got = [math.floor(x + 1e-9) for x in exact]
    for i in sorted(range(len(rows)), key=lambda i: (got[i] - exact[i], i))[: max(0, round(sum(exact)) - sum(got))]:
        got[i] += 1
    low = [min(r["least"] or 0, r["available"]) for r in rows]
    got = [max(low[i], min(g, r["available"])) for i, (g, r) in enumerate(zip(got, rows, strict=True))]
    want = min(size, sum(r["available"] for r in rows))
    while sum(got) != want:
        up = sum(got) < want
        open_ = [i for i, r in enumerate(rows) if (got[i] < r["available"] if up else got[i] > low[i])]
        if not open_:
            break
        left = abs(want - sum(got))
        weight = sum(max(exact[i], 1e-9) for i in open_)
        step = {i: min(left * max(exact[i], 1e-9) / weight, rows[i]["available"] - got[i] if up else got[i] - low[i]) for i in open_}
        whole = {i: math.floor(x) for i, x in step.items()}
        if not any(whole.values()):
            best = sorted(open_, key=lambda i: ((got[i] - exact[i]) * (1 if up else -1), i))[: int(left)]
            whole = dict.fromkeys(best, 1)
        for i, n in whole.items():
            got[i] += n if up else -n
    return got


def plan(df: DataFrame, key: str, labels: list[str], targets: DataFrame, share: str, least: str, fraction: float) -> DataFrame:
    """(labels, available, wanted, least, quota, weight, gap): the quota of each target pair.

    The quotas are those of the target shares raked within what is available and the minimums, so a pair
    that is short is made up for by pairs of the same labels. weight is the raked share of the pair over
    its plain share among the records. gap is quota minus what the target or the minimum asks for.
    """
    spark = df.sparkSession
    if targets.count() > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target cells")
    # One row per target pair, bounded by the check above.
    rows = [r.asDict() for r in availability(df, key, labels, targets, share, least, fraction).orderBy(*labels).collect()]
    size = int(rows[0]["size"]) if rows else 0
    supply = sum(r["available"] for r in rows)
    room = min(size, supply)
    asked = sum(float(r["share"] or 0) for r in rows)
    cells = [tuple(r[c] for c in labels) for r in rows]
    margins = [{} for _ in labels]
    for cell, r in zip(cells, rows, strict=True):
        for margin, label in zip(margins, cell, strict=True):
            margin[label] = margin.get(label, 0.0) + (float(r["share"] or 0) * room / asked if asked else 0.0)
    seeds = {cell: float(r["share"] or 0) if r["available"] else 0.0 for cell, r in zip(cells, rows, strict=True)}
    low = {cell: min(r["least"] or 0, r["available"]) for cell, r in zip(cells, rows, strict=True)}
    raked = rake(seeds, margins, low, {cell: r["available"] for cell, r in zip(cells, rows, strict=True)})
    got = quotas(rows, size, [raked.get(cell, 0.0) for cell in cells])
    out = []
    for cell, r, q in zip(cells, rows, got, strict=True):
        plain = r["available"] / supply if supply else 0.0
        weight = raked.get(cell, 0.0) / room / plain if plain and room else 0.0
        out.append((*cell, int(r["available"]), float(r["wanted"] or 0), int(r["least"] or 0), q, float(weight), float(q - max(float(r["wanted"] or 0), r["least"] or 0))))
    kinds = ", ".join(f"`{c}` string" for c in labels)
    return spark.createDataFrame(out, f"{kinds}, available bigint, wanted double, least int, quota int, weight double, gap double")


def margins(planned: DataFrame, labels: list[str]) -> DataFrame:
    """(kind, label, available, wanted, quota, gap) for every label of every margin: what the plan's sample leaves of the targets there."""
    sums = [F.sum(c).alias(c) for c in ("available", "wanted", "quota")]
    sides = [planned.groupBy(F.col(c).alias("label")).agg(*sums).select(F.lit(c).alias("kind"), "*", (F.col("quota") - F.col("wanted")).alias("gap")) for c in labels]
    return reduce(DataFrame.unionByName, sides)


def draw(df: DataFrame, key: str, labels: list[str], planned: DataFrame, seed: int = 7) -> DataFrame:
    """(key, labels, rank_key): the records of the sample, for each pair of labels as many as its quota.

    A record is drawn by the least exponential keys -ln(u) / weight of its pair, ties by its own key, so
    the sample does not depend on the order or the partitions of the table. Of a key with several labels
    the least pair counts; records whose labels name no target, or null keys, are never drawn.
    """
    tools = df.select(key, *[tidy(F.col(c)).alias(c) for c in labels]).where(f"`{key}` IS NOT NULL")
    tools = tools.groupBy(key).agg(F.min(F.struct(*labels)).alias("_l")).select(key, *[F.col(f"_l.{c}").alias(c) for c in labels])
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    goal = planned.where("quota > 0").select(*labels, "quota", "weight")
    keyed = tools.join(goal, labels).withColumn("_u", u).withColumn("rank_key", -F.log("_u") / F.greatest(F.col("weight"), F.lit(1e-12)))
    # In one pair the weight is the same, so the order of the keys is that of -ln(u): slots by 1 - u fill evenly.
    keyed = settle(keyed.withColumn("_slot", F.floor((1 - F.col("_u")) * SLOTS).cast("int")), "keyed")
    slots = keyed.groupBy(*labels, "_slot").agg(F.count(F.lit(1)).alias("n"), F.first("quota").alias("quota"))
    before = F.expr(f"sum(n) OVER (PARTITION BY {', '.join(labels)} ORDER BY _slot) - n")
    slots = slots.withColumn("before", before).where("before < quota").withColumn("room", F.col("quota") - F.col("before"))
    part = keyed.drop("quota").join(slots.select(*labels, "_slot", "n", "room"), [*labels, "_slot"])
    full = part.where("n <= room")
    rank = F.expr(f"row_number() OVER (PARTITION BY {', '.join(labels)}, _slot ORDER BY rank_key, {key})")
    last = part.where("n > room").withColumn("_r", rank).where("_r <= room")
    return full.select(key, *labels, "rank_key").unionByName(last.select(key, *labels, "rank_key"))
