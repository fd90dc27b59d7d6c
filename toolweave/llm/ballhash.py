"""Near-duplicate records by meet-in-the-middle ball hashing (problem 1).

A record's text becomes the set of its character shingles; MinHash over it gives ``tables`` fingerprints of
``symbols`` symbols each, plus a long bit sketch. Distance is counted in symbols erased: two fingerprints
that differ in one symbol are two apart, as each must lose that symbol for both to be alike. Each fingerprint
emits all variants within half that radius, those with one symbol erased, so that the two meet in the middle
at the variant without the symbol in which they differ. The variants are shuffled by value, and pairs that meet
are deduplicated, sifted by their sketches and verified by the exact similarity.

A symbol is a whole MinHash value, not a few bits of it, so a ball has one variant for each symbol however
large the alphabet is. The number of symbols follows the logarithm of the number of records, so that chance meetings per record
stay bounded, and the number of tables follows from it so that the recall just at the threshold is the same at every size.

The variants travel as sorted, delta-coded blocks, one per map batch and range of values, at about
five bytes a variant: the shuffle has few, large rows. The number of ranges follows the number of
records, so a range stays bounded; values that very many records share travel apart and meet in cells.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toolweave.llm.copies import classed, sent
from toolweave.operators.linking import group_pairs
from toolweave.plans.settle import settle

#: Probability that two records just at the threshold meet.
RECALL = 0.98
SKETCH_BINS = 128
#: Sketch bits that may differ: at a similarity of 0.7 a bit differs with probability 0.15.
SKETCH_LIMIT = 38
#: Variants in one range of values, and the bits of a value within its range.
RANGE_VARIANTS, RANGE_BITS = 600_000, 36
#: Records of one block, or of one range, above which those with an equal value are not paired inside a task.
OFTEN = 512
_MULT = np.uint64(0x9E3779B97F4A7C15)


def normal_text(c: Column) -> Column:
    """Lower case, each run of characters that are neither letters nor digits one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", " "))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles of all texts, and the row of each; whole texts, repeats kept.

    A text shorter than the width has one shingle, itself.
    """
    padded = [t if len(t) >= width else t.ljust(width, "\0") for t in texts]
    lengths = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - width + 1
    code = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(width):
        code *= np.uint64(0x100000001B3)
        code ^= points[k : k + n]
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)[:n]
    last = np.cumsum(lengths)
    ok = np.arange(n) <= (last - width)[row]
    return _mix(code[ok] * _MULT), row[ok]


def minima(hashes: np.ndarray, row: np.ndarray, rows: int, bins: int, shift: int) -> np.ndarray:
    """One-permutation MinHash: the least hash in each bin; an empty bin borrows from the next filled one."""
    least = np.full(rows * bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    at = row * bins + ((hashes >> np.uint64(shift)) % np.uint64(bins)).astype(np.int64)
    np.minimum.at(least, at, hashes)
    least = least.reshape(rows, bins)
    empty = least == np.iinfo(np.uint64).max
    step = np.uint64(0)
    while empty.any() and step < bins:
        step += np.uint64(1)
        borrowed = np.roll(least, -1, axis=1)
        least = np.where(empty, borrowed, least)
        empty = least == np.iinfo(np.uint64).max
    return least


def shape_for(rows: int, threshold: float, recall: float = RECALL, unlike: float = 0.06, meets: float = 8.0) -> tuple[int, int]:
    """(symbols, tables): the fewest variants with which two records of similarity ``threshold`` meet with probability ``recall``
    while about ``meets`` unlike records a record meet over all tables.

    ``unlike`` is the similarity that unrelated records have anyhow, through common phrases.
    """
    for symbols in range(5, 64):
        near = threshold**symbols + symbols * (1 - threshold) * threshold ** (symbols - 1)
        tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-near)))
        if rows * tables * symbols * unlike ** (symbols - 1) <= meets:
            break
    return symbols, tables


def fingerprints(texts: list[str], width: int, symbols: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints [rows, tables * symbols], sketch high, sketch low): each symbol is a hash of the least shingle in an order of its own."""
    hashes, row = shingle_hashes(texts, width)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, dtype=np.int64)
    prints = np.empty((len(texts), tables * symbols), dtype=np.uint64)
    for k in range(tables * symbols):
        prints[:, k] = _mix(np.minimum.reduceat(_order(hashes, k), first) + np.uint64(k))
    bit = (_mix(minima(_mix(hashes + _MULT), row, len(texts), SKETCH_BINS, 7)) >> np.uint64(17)) & np.uint64(1)
    packed = np.packbits(bit.astype(np.uint8), axis=1).view(">u8").astype(np.uint64).view(np.int64)
    return prints.view(np.int64), packed[:, 0], packed[:, 1]


def _order(hashes: np.ndarray, number: int) -> np.ndarray:
    """The hashes in one of the orders; they are mixed already, so one multiplication after a shift of them does."""
    x = (hashes ^ np.uint64(_KEYS[number % len(_KEYS)] + number // len(_KEYS))) * _MULT
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xC4CEB9FE1A85EC53)


_KEYS = np.random.default_rng(20).integers(0, 1 << 63, 4096, dtype=np.uint64).tolist()


def variants(prints: np.ndarray, symbols: int) -> np.ndarray:
    """[rows, tables * symbols]: a hash of each fingerprint without one of its symbols, for each of them, and of the place left out."""
    part = prints.view(np.uint64).reshape(len(prints), -1, symbols)
    tables = part.shape[1]
    place = _mix(np.arange(1, tables * symbols + 1, dtype=np.uint64) * _MULT).reshape(tables, symbols)
    part = _mix(part + place)
    return _mix(part.sum(axis=2, dtype=np.uint64)[:, :, None] - part + place).reshape(len(prints), tables * symbols)


def _pack(values: np.ndarray, rows: np.ndarray) -> bytes:
    """Ascending values as variable-length differences, the row numbers as two bytes each."""
    d = np.diff(values, prepend=0).astype(np.uint64)
    size = np.maximum(1, np.searchsorted(np.array([1 << (7 * k) for k in range(1, 9)], dtype=np.uint64), d, side="right") + 1)
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        sel = size > k
        byte = ((d[sel] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        more = (size[sel] > k + 1).astype(np.uint8) << 7
        out[(end - size)[sel] + k] = byte | more
    return len(values).to_bytes(8, "little") + rows.astype("<u2").tobytes() + out.tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    rows = np.frombuffer(blob, dtype="<u2", count=n, offset=8).astype(np.int64)
    raw = np.frombuffer(blob, dtype=np.uint8, offset=8 + 2 * n)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate(([0], last[:-1] + 1))
    d = np.zeros(n, dtype=np.int64)
    size = last - first + 1
    for k in range(int(size.max()) if n else 0):
        sel = size > k
        d[sel] |= (raw[first[sel] + k] & 127).astype(np.int64) << (7 * k)
    return np.cumsum(d), rows


def _meetings(value: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(less, greater): different records with an equal value, each two once.

    Sorted by value, step k pairs each entry with the one k places on, while any such pair still has
    equal values, so the work follows the pairs found.
    """
    found, k = [np.zeros((0, 2), dtype=np.int64)], 1
    live = np.flatnonzero(value[:-1] == value[1:])
    while len(live):
        a, b = who[live], who[live + k]
        found.append(np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)[a != b], axis=0))
        k += 1
        live = live[live + k < len(value)]
        live = live[value[live] == value[live + k]]
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[:, 0], pairs[:, 1]


def candidate_pairs(prints: DataFrame, rows: int, symbols: int, tables: int) -> DataFrame:
    """(a, b) with a < b from (pos bigint, prints array<bigint>): positions that meet at some variant.

    Positions ascend within a file, so a block of up to 2**16 of them is one base and short offsets.
    A value that more than OFTEN records of a block have leaves its block as rows and puts a mark into its
    range; a range passes the records of marked and of common values on as rows too. These meet by ``group_pairs``.
    """
    each = symbols * tables
    ranges = max(1, -(-rows * each // RANGE_VARIANTS))
    mask = np.uint64((1 << RANGE_BITS) - 1)

    def blocks_of(batches):
        pos, prints = np.zeros(0, dtype=np.int64), np.zeros((0, each), dtype=np.int64)
        for batch in batches:
            pos = np.concatenate((pos, batch.column(0).to_numpy()))
            prints = np.concatenate((prints, batch.column(1).flatten().to_numpy().reshape(-1, each)))
            while len(pos) >= 1 << 15:
                n = _stretch(pos)
                yield pos[:n], prints[:n]
                pos, prints = pos[n:], prints[n:]
        while len(pos):
            n = _stretch(pos)
            yield pos[:n], prints[:n]
            pos, prints = pos[n:], prints[n:]

    def emit(batches):
        for pos, prints in blocks_of(batches):
            h = variants(prints, symbols).reshape(-1)
            r = (((h >> np.uint64(RANGE_BITS)).astype(np.float64) * (ranges / float(1 << (64 - RANGE_BITS)))).astype(np.int64)).clip(0, ranges - 1)
            v, who = (h & mask).astype(np.int64), np.repeat(pos - pos[0], each)
            order = np.lexsort((v, r))
            r, v, who = r[order], v[order], who[order]
            head = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (r[1:] != r[:-1]))))
            size = np.diff(np.append(head, len(v)))
            often = np.repeat(size > OFTEN, size)
            out: list[tuple[int, int, bytes]] = []
            for kind, take in ((0, ~often), (1, head[size > OFTEN])):
                x, y, z = r[take], v[take], who[take]
                cut = np.searchsorted(x, np.arange(ranges + 1))
                out.extend((int(k), kind, _pack(y[cut[k] : cut[k + 1]], z[cut[k] : cut[k + 1]])) for k in np.flatnonzero(np.diff(cut)))
            if often.any():
                # Groups of their own, one a block, that only pass the records on.
                x, y, z = r[often], v[often], who[often]
                out.extend((-1 - int(pos[0] % 1_000_003), 2 + int(k), _pack(y[x == k], z[x == k])) for k in np.unique(x))
            base = pa.array(np.full(len(out), pos[0], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), base, pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], names=["_range", "_base", "_kind", "_blob"])

    def meet(got):
        values, records, marks, passed = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], []
        number = got.column("_range")[0].as_py()
        for base, kind, blob in zip(got.column("_base").to_pylist(), got.column("_kind").to_pylist(), got.column("_blob").to_pylist(), strict=True):
            v, w = _unpack(blob)
            if kind == 0:
                values.append(v)
                records.append(w + base)
            elif kind == 1:
                marks.append(v)
            else:
                passed.append((v | (kind - 2) << RANGE_BITS, w + base))
        value, who = np.concatenate(values), np.concatenate(records)
        order = np.argsort(value, kind="stable")
        value, who = value[order], who[order]
        head = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(head, len(value)))
        often = np.repeat((size > OFTEN) | np.isin(value[head], np.concatenate(marks)), size)
        passed.append((value[often] | max(number, 0) << RANGE_BITS, who[often]))
        a, b = _meetings(value[~often], who[~often])
        v, w = (np.concatenate(x) for x in zip(*passed, strict=True))
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.table({"a": pa.chunked_array([a, w]), "b": pa.chunked_array([pa.array(b), none(len(w))]), "v": pa.chunked_array([none(len(a)), pa.array(v)])})

    blocks = prints.mapInArrow(emit, "_range int, _base bigint, _kind int, _blob binary")
    met = settle(blocks.groupBy("_range").applyInArrow(meet, "a bigint, b bigint, v bigint"), "met")
    common = group_pairs(met.where("b IS NULL").select("v", F.col("a").alias("m")), ["v"], "m").select("a", "b")
    return met.where("b IS NOT NULL").select("a", "b").unionByName(common).distinct()


def _stretch(pos: np.ndarray) -> int:
    """Leading positions that ascend and lie within 2**16 of the first."""
    part = pos[: 1 << 16]
    bad = np.flatnonzero((part < part[0]) | (part - part[0] >= 1 << 16))
    return int(bad[0]) if len(bad) else len(part)


#: Texts whose fingerprints are made at once: their shingles fit a core's cache.
TEXTS = 256


def _printed(texts: DataFrame, width: int, symbols: int, tables: int) -> DataFrame:
    """(pos, cls, prints, hi, lo) from (doc, text). pos is unique and ascends in each partition; written at once, as it must not be recomputed."""
    kind = texts.schema["doc"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                prints, hi, lo = fingerprints(part.column(1).to_pylist(), width, symbols, tables)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(prints.reshape(-1)), symbols * tables).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(hi), pa.array(lo)], names=["cls", "prints", "hi", "lo"])

    printed = texts.mapInArrow(run, f"cls {kind}, prints array<bigint>, hi bigint, lo bigint")
    return settle(printed.select(F.monotonically_increasing_id().alias("pos"), "*"), "numbered")


def similar_pairs(df: DataFrame, key: str, text: Column, threshold: float, version: Column | None = None, width: int = 5, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(pairs: cls_a, cls_b, similarity), (members: key, cls) of the records of a table.

    pairs holds each two classes of equal text whose sets of distinct shingles have a Jaccard
    similarity of at least ``threshold``, cls_a < cls_b; members the class of every record whose key and text
    are not null. Of rows with the same key only the one with the least ``version`` counts (as text; null
    first), of several such that with the least hash. Empty texts are one class; texts below the width count as one shingle. The sketch limit
    is set for thresholds from 0.7. Misses have a chance only: at most 1 - ``recall`` of the pairs just at
    the threshold, whatever the size of the table, and far fewer above it; no record, class or meeting is capped.
    """
    members, unique = classed(df, key, text, version)
    rows = members.where("doc = cls").count()
    symbols, tables = shape_for(max(rows, 1), threshold, recall)
    reps = _printed(unique, width, symbols, tables)
    met = candidate_pairs(reps.select("pos", "prints"), rows, symbols, tables)
    side = lambda x: reps.select(F.col("pos").alias(x), F.col("cls").alias(f"cls_{x}"), F.col("hi").alias(f"hi_{x}"), F.col("lo").alias(f"lo_{x}"))
    apart = F.bit_count(F.col("hi_a").bitwiseXOR(F.col("hi_b"))) + F.bit_count(F.col("lo_a").bitwiseXOR(F.col("lo_b")))
    limit = math.ceil(SKETCH_LIMIT * (1 - threshold) / 0.3) + 4 if threshold > 0.7 else SKETCH_LIMIT
    sifted = settle(
        met.join(side("a"), "a").join(side("b"), "b").where(apart <= limit)
        .select(F.least("cls_a", "cls_b").alias("cls_a"), F.greatest("cls_a", "cls_b").alias("cls_b")), "sifted",
    )
    wanted, _ = sent(sifted.select(F.explode(F.array("cls_a", "cls_b")).alias("doc")).distinct())
    texts = settle(unique.join(wanted, "doc", "left_semi"), "texts")
    sides = sifted.join(texts.select(F.col("doc").alias("cls_a"), F.col("text").alias("text_a")), "cls_a")
    sides = sides.join(texts.select(F.col("doc").alias("cls_b"), F.col("text").alias("text_b")), "cls_b")

    def verify(batches):
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            value = np.array([_jaccard(x, y, width) for x, y in zip(a, b, strict=True)], dtype=np.float64)
            ok = np.flatnonzero(value >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)), pa.array(value[ok])], names=["cls_a", "cls_b", "similarity"])

    kind = df.schema[key].dataType.simpleString()
    pairs = sides.select("cls_a", "cls_b", "text_a", "text_b").mapInArrow(verify, f"cls_a {kind}, cls_b {kind}, similarity double")
    return pairs, members.select(F.col("doc").alias(key), "cls")


def _jaccard(a: str, b: str, width: int) -> float:
    x = {a[i : i + width] for i in range(max(1, len(a) - width + 1))}
    y = {b[i : i + width] for i in range(max(1, len(b) - width + 1))}
    both = len(x & y)
    return both / (len(x) + len(y) - both)


def member_pairs(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b) with key_a < key_b of records in similar or the same classes. Large classes are paired in cells."""
    same = group_pairs(members, ["cls"], key).select("a", "b")
    several = members.join(members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cls").select("cls", F.col(key).alias("_k"))
    # A class of one record is named by it and needs no join.
    a = several.select(F.col("cls").alias("cls_a"), F.col("_k").alias("_x"))
    b = several.select(F.col("cls").alias("cls_b"), F.col("_k").alias("_y"))
    both = pairs.join(a, "cls_a", "left").join(b, "cls_b", "left").select(F.coalesce("_x", "cls_a").alias("a"), F.coalesce("_y", "cls_b").alias("b"))
    both = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(same)
    return both.select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))


def class_links(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key, cls, copies, links): one row per record: its class of equal texts, the records of the class, and the number of other classes similar to it."""
    degree = reduce(DataFrame.unionByName, [pairs.select(F.col(f"cls_{s}").alias("cls")) for s in "ab"]).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    return members.join(copies, "cls").join(degree, "cls", "left").select(key, "cls", "copies", F.coalesce("links", F.lit(0)).alias("links"))
