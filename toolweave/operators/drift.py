"""Schemas that drift between the files of a feed (problem 3).

Every member of every record becomes a cell with its JSON type and a hash of its value. Cells are
profiled by file: presence, types and a MinHash sketch of (key, value). Neighbouring files are compared;
members that vanished and appeared are candidates, weighted by the share of equal values over common keys,
the sketches' agreement and the likeness of names, and a bipartite matching of each file picks the
renames. The matched names of a feed become one column of the unified table.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.operators.shred import kind_of
from toolweave.plans.settle import settle

#: A field belongs to a file if this share of the records has it; a rename needs that share of equal values.
PRESENT = 0.2
EQUAL = 0.8
SKETCHES = 8
FILE = ["feed", "seq"]


def _number(text: str) -> object:
    x = float(text)
    return int(x) if x.is_integer() and abs(x) < 2**63 else x


def _record(raw: str | None) -> dict | None:
    if not raw:
        return None
    try:
        value = json.loads(raw, parse_float=_number)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _hash(x: object) -> int:
    return xxhash.xxh3_64_intdigest(json.dumps(x, sort_keys=True, ensure_ascii=False).encode("utf-8", "surrogatepass")) - (1 << 63)


def cells(df: DataFrame, feed: str, seq: str, key_member: str, raw: str) -> DataFrame:
    """(feed, seq, key, field, outer, kind, value): one row per member of each readable record and per
    member of its object members (``outer`` names the latter's holder), plus one with field '' per record.

    value is a 64-bit hash of the canonical JSON, null for null. Lines that are not JSON objects give none.
    """

    def run(batches):
        for batch in batches:
            at, key, field, outer, kind, value = [], [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                record = _record(text)
                if record is None:
                    continue
                own = record.get(key_member)
                own = own if own is None or isinstance(own, str) else json.dumps(own)
                entries = [("", None, None)]
                for name, x in record.items():
                    if name != key_member and name != "":
                        entries.append((name, None, x))
                        if isinstance(x, dict):
                            entries.extend((f"{name}.{inner}", name, y) for inner, y in x.items())
                for name, holder, x in entries:
                    at.append(i)
                    key.append(own)
                    field.append(name)
                    outer.append(holder)
                    kind.append(kind_of(x))
                    value.append(None if x is None else _hash(x))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(key, pa.string()), pa.array(field, pa.string()), pa.array(outer, pa.string()), pa.array(kind, pa.string()), pa.array(value, pa.int64())],
                names=["feed", "seq", "key", "field", "outer", "kind", "value"],
            )

    return df.select(F.col(feed).alias("feed"), F.col(seq).cast("bigint").alias("seq"), F.col(raw).alias("raw")).mapInArrow(
        run, "feed string, seq bigint, key string, field string, outer string, kind string, value bigint"
    )


def profiles(cell: DataFrame) -> DataFrame:
    """(feed, seq, field, outer, n, type, sketch, objects, records): the fields that belong to each file.

    type is the most frequent JSON type of values other than null, of equals the first by name.
    """
    kinds = ["array", "boolean", "number", "object", "string"]
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    sketch = F.array(*[F.min(F.xxhash64("key", "value", F.lit(i))) for i in range(SKETCHES)]).alias("sketch")
    by = cell.groupBy(*FILE, "field", "outer").agg(F.count(F.lit(1)).alias("n"), *counts, sketch)
    best = F.greatest(*kinds)
    kind = F.coalesce(*[F.when((F.col(k) == best) & (best > 0), F.lit(k)) for k in kinds])
    by = by.withColumn("type", kind)
    records = by.where("field = ''").select(*FILE, F.col("n").alias("records"))
    holders = by.where("outer IS NULL AND field <> ''").select(*FILE, F.col("field").alias("outer"), F.col("object").alias("objects"))
    fields = by.where("field <> ''").join(records, FILE).join(holders, [*FILE, "outer"], "left")
    of = F.when(F.col("outer").isNull(), F.col("records")).otherwise(F.col("objects"))
    present = F.col("n") >= F.lit(PRESENT) * of
    return fields.where(present).select(*FILE, "field", "outer", "n", "type", "sketch", "records")


def name_likeness(a: str, b: str) -> float:
    """Dice coefficient of the letter pairs of two names, case and marks apart."""
    x, y = ("".join(c for c in s.lower() if c.isalnum()) for s in (a, b))
    p, q = {x[i : i + 2] for i in range(len(x) - 1)}, {y[i : i + 2] for i in range(len(y) - 1)}
    return 2 * len(p & q) / (len(p) + len(q)) if p or q else float(x == y)


def matching(weight: list[list[float]]) -> list[int]:
    """Column of each row (-1: none) in a bipartite matching of greatest total weight; weights above 0 count.

    Successive longest augmenting paths over the rows, by Bellman-Ford on the alternating graph.
    """
    rows, columns = len(weight), len(weight[0]) if weight else 0
    of_row, of_column = [-1] * rows, [-1] * columns
    while True:
        gain = [0.0 if of_row[r] < 0 else float("-inf") for r in range(rows)]
        reach, via = [float("-inf")] * columns, [-1] * columns
        for _ in range(rows + 1):
            changed = False
            for r in range(rows):
                for c in range(columns):
                    if gain[r] > float("-inf") and weight[r][c] > 0 and of_row[r] != c and gain[r] + weight[r][c] > reach[c] + 1e-12:
                        reach[c], via[c], changed = gain[r] + weight[r][c], r, True
            for c in range(columns):
                r = of_column[c]
                if r >= 0 and reach[c] - weight[r][c] > gain[r] + 1e-12:
                    gain[r], changed = reach[c] - weight[r][c], True
            if not changed:
                break
        free = [c for c in range(columns) if of_column[c] < 0 and reach[c] > 1e-12]
        if not free:
            return of_row
        c = max(free, key=lambda c: reach[c])
        while c >= 0:
            r = via[c]
            before = of_row[r]
            of_row[r], of_column[c] = c, r
            c = before


def changes(df: DataFrame, feed: str, seq: str, file_name: str, key_member: str, raw: str) -> DataFrame:
    """(feed, seq, file_name, change, old_field, new_field) of each file against the one before it.

    change is renamed, removed (new_field ''), added (old_field '') or retyped. Files without a readable
    record, or whose predecessor is missing, have no changes. A value that is null on either side does not
    count for a rename; a key that stands twice in a file counts with its greatest hash.
    """
    cell = settle(cells(df, feed, seq, key_member, raw), "cells")
    profile = settle(profiles(cell), "profiles")
    named = df.groupBy(F.col(feed).alias("feed"), F.col(seq).cast("bigint").alias("seq")).agg(F.min(file_name).alias("file_name"))
    files = profile.select(*FILE).distinct()
    pairs = files.join(files.select("feed", (F.col("seq") + 1).alias("seq")), FILE)
    cur = profile.join(pairs, FILE, "left_semi").select(*FILE, "field", "outer", F.col("type").alias("new_type"), F.col("sketch").alias("new_sketch"))
    prev = profile.select("feed", (F.col("seq") + 1).alias("seq"), "field", "outer", F.col("type").alias("old_type"), F.col("sketch").alias("old_sketch"))
    prev = prev.join(pairs, FILE, "left_semi")
    # Top-level fields have the holder '' here, so that all four columns can be joined by name.
    named_by = [*FILE, "field", "outer"]
    prev, cur = (x.fillna("", ["outer"]) for x in (prev.withColumn("was", F.lit(True)), cur.withColumn("is", F.lit(True))))
    both = prev.join(cur, named_by, "full").fillna(False, ["was", "is"])
    held = both.where("outer = '' AND was AND `is` AND old_type = 'object' AND new_type = 'object'").select(*FILE, F.col("field").alias("outer"))
    inner = both.where("outer <> ''").join(held, [*FILE, "outer"], "left_semi")
    state = settle(both.where("outer = ''").unionByName(inner), "state")
    gone = state.where("was AND NOT `is`").select(*FILE, F.col("field").alias("old_field"), "old_sketch")
    new = state.where("`is` AND NOT was").select(*FILE, F.col("field").alias("new_field"), "new_sketch")
    values = cell.where("key IS NOT NULL AND value IS NOT NULL").groupBy(*FILE, "key", "field").agg(F.max("value").alias("value"))
    before = values.withColumn("seq", F.col("seq") + 1).withColumnRenamed("field", "old_field").join(gone.drop("old_sketch"), [*FILE, "old_field"], "left_semi")
    after = values.withColumnRenamed("field", "new_field").withColumnRenamed("value", "new_value").join(new.drop("new_sketch"), [*FILE, "new_field"], "left_semi")
    rate = before.join(after, [*FILE, "key"]).groupBy(*FILE, "old_field", "new_field").agg(F.count(F.lit(1)).alias("common"), F.count_if(F.col("value") == F.col("new_value")).alias("same"))
    edges = rate.where(F.col("same") >= F.lit(EQUAL) * F.col("common")).join(gone, [*FILE, "old_field"]).join(new, [*FILE, "new_field"])
    agree = F.aggregate(F.zip_with("old_sketch", "new_sketch", lambda a, b: F.when(a == b, 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / SKETCHES
    edges = edges.select(*FILE, "old_field", "new_field", (F.col("same") / F.col("common")).alias("share"), agree.alias("agree"))
    renamed = edges.groupBy(*FILE).applyInPandas(_renames, "feed string, seq bigint, old_field string, new_field string")
    renamed = settle(renamed, "renamed")
    removed = gone.select(*FILE, "old_field").join(renamed, [*FILE, "old_field"], "left_anti")
    added = new.select(*FILE, "new_field").join(renamed, [*FILE, "new_field"], "left_anti")
    retyped = state.where("was AND `is` AND old_type <> new_type")
    row = lambda x, change, old, new: x.select(*FILE, F.lit(change).alias("change"), old.alias("old_field"), new.alias("new_field"))
    empty: Column = F.lit("")
    found = (
        row(renamed, "renamed", F.col("old_field"), F.col("new_field"))
        .unionByName(row(removed, "removed", F.col("old_field"), empty))
        .unionByName(row(added, "added", empty, F.col("new_field")))
        .unionByName(row(retyped, "retyped", F.col("field"), F.col("field")))
    )
    return found.join(named, FILE).select(*FILE, "file_name", "change", "old_field", "new_field")


def _renames(edges: pd.DataFrame) -> pd.DataFrame:
    """The matched edges of one pair of files; a file has few fields, so the group is small."""
    old, new = sorted(set(edges.old_field)), sorted(set(edges.new_field))
    weight = [[0.0] * len(new) for _ in old]
    for e in edges.itertuples():
        weight[old.index(e.old_field)][new.index(e.new_field)] = 1 + e.share + 0.2 * e.agree + 0.2 * name_likeness(e.old_field, e.new_field)
    got = [(old[r], new[c]) for r, c in enumerate(matching(weight)) if c >= 0]
    return pd.DataFrame({"feed": edges.feed.iloc[0], "seq": edges.seq.iloc[0], "old_field": [a for a, _ in got], "new_field": [b for _, b in got]})


def _columns_of(pairs: pd.DataFrame) -> pd.DataFrame:
    """Names of a feed that renames link, under the first of them by the alphabet; a feed has few distinct names."""
    over = {x: x for x in [*pairs.old_field, *pairs.new_field]}

    def top(x: str) -> str:
        while over[x] != x:
            x = over[x]
        return x

    for a, b in zip(pairs.old_field, pairs.new_field, strict=True):
        x, y = sorted((top(a), top(b)))
        over[y] = x
    return pd.DataFrame({"feed": pairs.feed.iloc[0], "field": list(over), "column": [top(x) for x in over]})


def unified(df: DataFrame, feed: str, seq: str, row: str, key_member: str, raw: str, change: DataFrame) -> DataFrame:
    """(feed, seq, row_no, key, cells map<string,string>): the readable records of all files with the
    members under one name per feed, values as JSON text; of two members of one column the non-null one,
    then the greater text. Only top-level members are renamed."""
    names = change.where("change = 'renamed'").select("feed", "old_field", "new_field").distinct()
    names = names.groupBy("feed").applyInPandas(_columns_of, "feed string, field string, column string")

    def run(batches):
        for batch in batches:
            at, key, field, value = [], [], [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                record = _record(text)
                if record is None:
                    continue
                own = record.pop(key_member, None)
                for name, x in [("", None), *record.items()]:
                    at.append(i)
                    key.append(own if own is None or isinstance(own, str) else json.dumps(own))
                    field.append(name)
                    value.append(None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in range(3)), pa.array(key, pa.string()), pa.array(field, pa.string()), pa.array(value, pa.string())], names=["feed", "seq", "row_no", "key", "field", "value"])

    source = df.select(F.col(feed).alias("feed"), F.col(seq).cast("bigint").alias("seq"), F.col(row).cast("bigint").alias("row_no"), F.col(raw).alias("raw"))
    member = source.mapInArrow(run, "feed string, seq bigint, row_no bigint, key string, field string, value string")
    member = member.join(names, ["feed", "field"], "left").withColumn("column", F.coalesce("column", "field"))
    one = member.groupBy("feed", "seq", "row_no", "key", "column").agg(F.max("value").alias("value"))
    entries = F.collect_list(F.when(F.col("column") != "", F.struct("column", "value")))
    return one.groupBy("feed", "seq", "row_no", "key").agg(F.map_from_entries(F.array_sort(entries)).alias("cells"))
