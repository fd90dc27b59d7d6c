"""Long exact spans shared between records (problem 10), by MinHash banding of paragraphs.

A text is cut into paragraphs. Their MinHash signatures over character shingles are banded, with the bands
tuned to the recall asked for; paragraphs that collide in a band are joined and verified.

``shared_spans`` finds every span of at least ``least`` characters. Layout breaks can't serve it, as texts that
share a span need not break at the same places in it. So its paragraphs are cut by content: each starts where
the hash of the next characters is the least within ``least - PARAGRAPH`` places and has PARAGRAPH
characters. Every shared span holds at least one such paragraph whole, the same one in both texts. Paragraphs
of similarity 1 collide in any banding, so the tuning settles on one band and recall is 1. Paragraphs
that collide are verified to be equal, and what is around them to be long enough, and then the two texts are
compared along their alignment; all maximal shared spans on it count.

``removals`` clusters the paragraphs of the layout, by word shingles, at a similarity below 1.

A paragraph that stands very often may be a short phrase that leads nowhere. Its occurrences are not paired:
the whole windows of ``least`` characters around them are grouped by a 128-bit hash, and texts meet where a
window stands in both and does not go on to the left in both, which is once for each maximal span.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.llm.copies import classed, sent
from toolweave.llm.leaks import slices
from toolweave.operators.linking import components, group_pairs
from toolweave.plans.settle import drop, settle

#: Characters of a content-cut paragraph, and of the shingles of its signature.
PARAGRAPH, GRAM = 120, 16
#: Most rows of a band.
ROWS = 2
#: Occurrences of one paragraph up to which they are paired at once; beyond it whole windows meet. The result is the same.
PAIRED = 64
#: Characters cut into paragraphs at once: the arrays over them fit a core's cache.
SLICE = 100_000
_ODD = 0x100000001B3


def tuned(similarity: float, recall: float = 0.98, most: int = 24, rows_most: int = 12) -> tuple[int, int]:
    """(bands, rows): of up to ``most`` bands the ones with the most rows that still find paragraphs of ``similarity``
    with a probability of ``recall``; among equal rows the fewest bands. Similarity 1 needs one band."""
    chance = lambda b, r: 1 - (1 - similarity**r) ** b
    rows = max((r for r in range(1, rows_most + 1) if chance(most, r) >= recall), default=1)
    return next((b for b in range(1, most + 1) if chance(b, rows) >= recall), most), rows


def points_of(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each stretch of ``width`` code points, built by doubling."""
    cur, cur_len = points.astype(np.uint64) + np.uint64(1), 1
    res, res_len = None, 0
    rest = width
    while rest:
        shift = np.uint64(pow(_ODD, cur_len, 1 << 64))
        if rest & 1:
            if res is None:
                res, res_len = cur, cur_len
            else:
                n = max(0, len(points) - res_len - cur_len + 1)
                res = res[:n] * shift + cur[res_len : res_len + n]
                res_len += cur_len
        rest >>= 1
        if rest:
            n = max(0, len(points) - 2 * cur_len + 1)
            cur = cur[:n] * shift + cur[cur_len : cur_len + n]
            cur_len *= 2
    res = res * np.uint64(0x9E3779B97F4A7C15)
    res ^= res >> np.uint64(29)
    res *= np.uint64(0xBF58476D1CE4E5B9)
    res ^= res >> np.uint64(32)
    return res


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) over each stretch of ``width`` values."""
    cur, size = x, 1
    while size * 2 <= width:
        cur = best(cur[:-size], cur[size:])
        size *= 2
    return best(cur[: len(x) - width + 1], cur[width - size : width - size + len(x) - width + 1]) if size < width else cur


def permuted(h: np.ndarray, number: int) -> np.ndarray:
    """The hashes in the order of one of the permutations."""
    h = (h ^ np.uint64((0x9E3779B97F4A7C15 * (2 * number + 1)) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def cut_paragraphs(texts: list[str], least: int, rows: int, length: int = PARAGRAPH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(band value, hash of the whole paragraph, text number, offset) of the content-cut paragraphs of all texts."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = points_of(texts)
    if len(points) < least:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = gram_hashes(points, gram)
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), lengths)[: len(h)]
    outside = np.arange(len(h)) > (ends - length)[row]
    start = permuted(h, 0)
    start[outside] = np.uint64(0xFFFFFFFFFFFFFFFF)
    width = least - length + 1
    low = _sliding(start, width, np.minimum)
    around = np.concatenate((np.zeros(width - 1, dtype=np.uint64), low, np.zeros(width - 1, dtype=np.uint64)))
    at = np.flatnonzero((_sliding(around, width, np.maximum) == start) & ~outside)
    band = np.zeros(len(at), dtype=np.uint64)
    for k in range(rows):
        signature = _sliding(permuted(h, k + 1), length - gram + 1, np.minimum)[at]
        band = permuted(band * np.uint64(_ODD) + signature, k)
    return band, gram_hashes(points, length)[at], row[at], at - (ends - lengths)[row[at]]


def _prints(texts: DataFrame, least: int, rows: int) -> DataFrame:
    """(k, doc, off) of every content-cut paragraph of (doc, text): k stands for its band and its content."""

    def run(batches):
        for batch in batches:
            held = [k for k, t in enumerate(batch.column(1).to_pylist()) if len(t) >= least]
            raw = batch.column(1).take(pa.array(held, pa.int64())).to_pylist()
            docs = batch.column(0).to_numpy()[np.array(held, dtype=np.int64)]
            for at, part in slices(raw, SLICE):
                band, content, row, off = cut_paragraphs(part, least, rows)
                k = permuted(band * np.uint64(_ODD) + content, 0)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(docs[at:][row]), pa.array(off.astype(np.int32))], names=["k", "doc", "off"])

    return texts.mapInArrow(run, "k bigint, doc bigint, off int")


def stretches(a: np.ndarray, b: np.ndarray, shift: int, least: int) -> list[tuple[int, int]]:
    """All maximal equal stretches of at least ``least`` points of a and b on the diagonal i - j = ``shift``:
    their starts in a and their lengths."""
    low, high = max(0, shift), min(len(a), len(b) + shift)
    if high - low < least:
        return []
    differ = np.flatnonzero(a[low:high] != b[low - shift : high - shift])
    start = np.concatenate(([0], differ + 1))
    length = np.append(differ, high - low) - start
    at = np.flatnonzero(length >= least)
    return list(zip((start[at] + low).tolist(), length[at].tolist(), strict=True))


@dataclass
class Shared:
    """What ``search`` found. members: (key, cls, n_chars) of every record; pairs: (a, b, d), the alignments with
    a long enough span through paragraphs that stand up to PAIRED times; texts: (doc, text) of the texts in question; windows: (w1, w2, doc, start, before, after, cut), the places of
    whole windows around more common ones that stand in several texts; cut says whether some of these places
    don't go on to the left in the same way. a, b and doc name classes of equal text."""

    key: str
    least: int
    members: DataFrame
    pairs: DataFrame
    texts: DataFrame
    windows: DataFrame

    def cold(self) -> DataFrame:
        """(a, b, start_a, start_b, length): the maximal spans on the alignments of ``pairs``."""
        return _verified(self.pairs, self.texts, self.least)


def search(df: DataFrame, key: str, text: str, least: int = 200) -> Shared:
    """Finds what the records of (key, text) share; see ``shared_spans``."""
    members, unique = classed(df, key, F.col(text))
    _, rows = tuned(1.0, rows_most=ROWS)
    prints = settle(_prints(unique, least, rows), "prints")
    often = prints.groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    live = settle(prints.join(often, "k"), "live")
    texts = settle(unique.join(sent(live.select("doc").distinct())[0], "doc", "left_semi"), "texts")
    met = group_pairs(_around(live.where(F.col("n") <= PAIRED), texts, least), ["k"], "doc", ["off", "lead", "part", "last"], F.expr("NOT coalesce(last_l = last_r, false)"))
    pairs = settle(_long_enough(met, least).distinct(), "pairs")
    drop(prints)
    return Shared(key, least, members.withColumnRenamed("doc", key), pairs, texts, _windows(live.where(F.col("n") > PAIRED), texts, least))


def _around(cold: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """(k, doc, off, lead, part, last): the places with as much of the text around them as a span of ``least`` characters
    through the paragraph can have, ``lead`` of them before it. last stands for the paragraph before if it overlaps or touches this one."""
    places = cold.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("off", "k"))).alias("places"))
    more = least - PARAGRAPH

    def run(batches):
        for batch in batches:
            out = []
            for doc, places, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before = None
                for x in places:
                    off = x["off"]
                    lead = min(off, more)
                    near = before is not None and off - before["off"] <= PARAGRAPH
                    out.append((x["k"], doc, off, lead, text[off - lead : off + PARAGRAPH + more], f"{before['k']} {off - before['off']}" if near else None))
                    before = x
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["k", "doc", "off", "lead", "part", "last"])

    held = places.join(texts, "doc").select("doc", "places", "text")
    return held.mapInArrow(run, "k bigint, doc bigint, off int, lead int, part string, last string")


def common(x: str, y: str) -> int:
    """Characters with which both texts begin."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if x[low:mid] == y[low:mid] else (low, mid - 1)
    return low


def _long_enough(met: DataFrame, least: int) -> DataFrame:
    """(a, b, d): the alignments d = place in a - place in b of pairs of places that stand in an equal stretch of ``least`` characters."""

    def run(batches):
        for batch in batches:
            cols = {n: batch.column(k).to_pylist() for k, n in enumerate(batch.schema.names)}
            ok = []
            for x, y, i, j in zip(cols["part_a"], cols["part_b"], cols["lead_a"], cols["lead_b"], strict=True):
                right = common(x[i:], y[j:])
                ok.append(right >= PARAGRAPH and right + common(x[:i][::-1], y[:j][::-1]) >= least)
            mask = pa.array(ok, pa.bool_())
            d = np.array(cols["off_a"], dtype=np.int32) - np.array(cols["off_b"], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(d, pa.int32()).filter(mask)], names=["a", "b", "d"])

    return met.select("a", "b", "off_a", "off_b", "lead_a", "lead_b", "part_a", "part_b").mapInArrow(run, "a bigint, b bigint, d int")


def _verified(pairs: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    sides = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    sides = sides.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        for batch in batches:
            out = []
            for a, b, d, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.extend((a, b, start, start - d, length) for start, length in stretches(points_of([x]), points_of([y]), d, least))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "start_a", "start_b", "length"])

    return sides.select("a", "b", "d", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, start_a bigint, start_b bigint, length bigint")


def _windows(hot: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """All whole windows around very common paragraphs that stand in several texts."""
    kinds = "w1 bigint, w2 bigint, doc bigint, start int, before bigint, after bigint"
    if hot.isEmpty():
        return hot.sparkSession.createDataFrame([], f"{kinds}, cut_before boolean, cut_after boolean")
    places = hot.groupBy("doc").agg(F.sort_array(F.collect_set("off")).alias("offs"))
    held = places.join(texts, "doc").select("doc", "offs", "text")

    def run(batches):
        for batch in batches:
            for doc, offs, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                points = points_of([text])
                wanted = np.zeros(len(points) + 1, dtype=np.int64)
                low = np.maximum(0, np.array(offs) + PARAGRAPH - least)
                high = np.minimum(np.array(offs), len(points) - least) + 1
                ok = high > low
                np.add.at(wanted, low[ok], 1)
                np.add.at(wanted, high[ok], -1)
                at = np.flatnonzero(np.cumsum(wanted) > 0)
                if not len(at):
                    continue
                h = gram_hashes(points, least)[at]
                g = gram_hashes(points ^ np.uint32(0x5BD1), least)[at]
                # A text's own start or end goes on like no other.
                none = -1 - (doc & ((1 << 62) - 1))
                before = np.where(at > 0, points[at - 1].astype(np.int64), none)
                stop = at + least
                after = np.where(stop < len(points), points[np.minimum(stop, len(points) - 1)].astype(np.int64), none)
                columns = [h.view(np.int64), g.view(np.int64), np.full(len(at), doc, dtype=np.int64), at.astype(np.int32), before, after]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["w1", "w2", "doc", "start", "before", "after"])

    windows = settle(held.mapInArrow(run, kinds), "windows")
    differ = lambda c: (F.min(c) < F.max(c)).alias(f"cut_{c}")
    kept = windows.groupBy("w1", "w2").agg(F.min("doc").alias("_lo"), F.max("doc").alias("_hi"), differ("before"), differ("after")).where("_lo < _hi").drop("_lo", "_hi")
    return settle(windows.join(kept, ["w1", "w2"]), "shared")


def hot_spans(found: Shared) -> DataFrame:
    """The maximal spans that hold very common paragraphs only. Windows that don't go on to the left in both
    texts are their starts and those that don't to the right their ends, in turn along a diagonal."""
    w = found.windows
    side = lambda c: group_pairs(w.where(f"cut_{c}"), ["w1", "w2"], "doc", ["start", c], F.expr(f"{c}_l <> {c}_r")).select(
        "a", "b", (F.col("start_a") - F.col("start_b")).alias("d"), F.col("start_a").cast("bigint").alias("at")
    )
    at = side("before").distinct().withColumn("end", F.lit(False)).unionByName(side("after").distinct().withColumn("end", F.lit(True)))
    at = at.join(found.pairs, ["a", "b", "d"], "left_anti").groupBy("a", "b", "d")
    lists = at.agg(F.sort_array(F.collect_list(F.when(~F.col("end"), F.col("at")))).alias("s"), F.sort_array(F.collect_list(F.when(F.col("end"), F.col("at")))).alias("e"))
    rows = lists.select("a", "b", "d", F.explode(F.arrays_zip("s", "e")).alias("_x"))
    return rows.select("a", "b", F.col("_x.s").alias("start_a"), (F.col("_x.s") - F.col("d")).alias("start_b"), (F.col("_x.e") - F.col("_x.s") + found.least).alias("length"))


def shared_spans(df: DataFrame, key: str, text: str, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """(spans: a, b, start_a, start_b, length), (members: key, cls, n_chars).

    Members holds the class of every record whose text is not null: records with equal text are one
    class, named by its least key. Spans holds the maximal stretches of at least ``least`` characters
    (code points, as they are) that stand in the texts of two classes a < b, each alignment with a row of its own. Texts
    shorter than ``least`` take part as copies only. Keys must be bigint; a key that stands twice with
    different texts counts with one of them, that of the least hash. Empty tables give empty results.
    """
    found = search(df, key, text, least)
    return found.cold().unionByName(hot_spans(found)), found.members


def linked(found: Shared) -> DataFrame:
    """(a, b), a < b: the classes that share a span, each pair once."""
    w = found.windows.where("cut_before").groupBy("w1", "w2", "doc").agg(F.min("before").alias("lo"), F.max("before").alias("hi"))
    # A pair that goes on to the left in the same way stands in the window before, too.
    hot = group_pairs(w, ["w1", "w2"], "doc", ["lo", "hi"], F.expr("NOT (lo_l = hi_l AND lo_r = hi_r AND lo_l = lo_r)"))
    return found.pairs.select("a", "b").unionByName(hot.select("a", "b")).distinct()


def found_pairs(found: Shared) -> DataFrame:
    """(key_a, key_b), key_a < key_b: records that share a span, copies of one text included."""
    key, members = found.key, found.members
    same = group_pairs(members.where(F.col("n_chars") >= found.least), ["cls"], key).select("a", "b")
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    links = linked(found)
    # Classes of one record need no join; those of several are expanded.
    several = members.join(sizes.where("n > 1"), "cls").select("cls", F.col(key).alias("_k"))
    both = links.join(several.select(F.col("cls").alias("a"), F.col("_k").alias("_x")), "a", "left").join(several.select(F.col("cls").alias("b"), F.col("_k").alias("_y")), "b", "left")
    both = both.select(F.coalesce("_x", "a").alias("a"), F.coalesce("_y", "b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return both.unionByName(same).select(F.col("a").alias(f"{key}_a"), F.col("b").alias(f"{key}_b"))


def links_by_class(found: Shared) -> DataFrame:
    """(key, cls, copies, links): one row per record: the class of its text, the records of that class, and the number of other classes it shares a span with."""
    ends = linked(found)
    degree = ends.select(F.col("a").alias("cls")).unionByName(ends.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    copies = found.members.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"))
    return found.members.join(copies, "cls").join(degree, "cls", "left").select(found.key, "cls", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def shared_share(found: Shared) -> DataFrame:
    """(key, n_chars, shared_chars): how many characters of each record also stand in another record,
    within spans of at least ``least`` characters; a whole copy is shared as a whole."""
    key, members, least = found.key, found.members, found.least
    cold = settle(found.cold(), "cold")
    sides = [cold.select(F.col(x).alias("cls"), F.col(f"start_{x}").alias("lo"), (F.col(f"start_{x}") + F.col("length")).alias("hi")) for x in "ab"]
    hot = found.windows.select(F.col("doc").alias("cls"), F.col("start").cast("bigint").alias("lo"), (F.col("start") + F.lit(least)).cast("bigint").alias("hi"))
    ordered = sides[0].unionByName(sides[1]).unionByName(hot).distinct()
    ordered = ordered.withColumn("before", F.expr("max(hi) OVER (PARTITION BY cls ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
    covered = ordered.groupBy("cls").agg(F.sum(F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce("before", "lo")))).alias("covered"))
    copies = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    whole = (F.col("n") > 1) & (F.col("n_chars") >= least)
    return (
        members.join(copies, "cls").join(covered, "cls", "left")
        .select(key, F.col("n_chars").cast("bigint").alias("n_chars"), F.when(whole, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint").alias("shared_chars"))
    )


WORDS, SIMILAR, RECALL = 5, 0.8, 0.98
_BREAK = re.compile(r"\n\s*\n|\r\n\s*\r\n")


def layout_paragraphs(text: str, least: int) -> list[tuple[int, str]]:
    """(offset, paragraph) of the stretches between blank lines that have at least ``least`` characters without the white space at their ends."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        bare = part.strip()
        if len(bare) >= least:
            out.append((at + len(part) - len(part.lstrip()), bare))
        at = m.end() if m else end
    return out


def word_shingles(text: str) -> set[tuple[str, ...]]:
    words = text.lower().split()
    return {tuple(words[k : k + WORDS]) for k in range(max(1, len(words) - WORDS + 1))}


def band_values(text: str, bands: int, rows: int) -> list[int]:
    """The value of each band of a paragraph's MinHash signature over its shingles of five words."""
    import hashlib

    h = np.array([int.from_bytes(hashlib.blake2b(" ".join(s).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for s in word_shingles(text)], dtype=np.uint64)
    least = np.array([permuted(h, k).min() for k in range(bands * rows)]).reshape(bands, rows)
    value = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        value = permuted(value * np.uint64(_ODD) + least[:, k], k)
    return value.view(np.int64).tolist()


def paragraph_clusters(df: DataFrame, key: str, text: str, least: int = 80, similarity: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """(key, off, n_chars, cluster, kept): every layout paragraph of at least ``least`` characters with its cluster; kept is true for one place of each cluster.

    Paragraphs of a cluster are linked by similarities of at least ``similarity``: the Jaccard similarity of their
    sets of shingles of five words in lower case. Equal paragraphs are one class, whatever their number. Bands are tuned so that a pair just
    at the similarity is found with probability ``recall``; each collision is verified exactly. In a band each
    paragraph is first verified against the band's least one; those alike are one cluster already, and only the
    others meet the rest, so a large group of near copies costs its size and not its square. Null keys, null
    and short texts have no paragraphs.
    """

    def parts(batches):
        for batch in batches:
            at, off, out = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for o, p in layout_paragraphs(t, least):
                    at.append(i)
                    off.append(o)
                    out.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(off, pa.int32()), pa.array(out, pa.string())], names=["doc", "off", "part"])

    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    held = rows.mapInArrow(parts, "doc bigint, off int, part string").withColumn("_h", F.unhex(F.md5("part")))
    places = settle(held.select("doc", "off", F.length("part").alias("n_chars"), "_h").distinct(), "places")
    # A paragraph's class is numbered by its hash; the texts of distinct paragraphs are kept once.
    number = F.xxhash64("_h").alias("p")
    distinct = settle(held.groupBy("_h").agg(F.first("part").alias("part")).select(number, "part"), "paragraphs")
    bands, rows_of = tuned(similarity, recall)

    def banded(batches):
        for batch in batches:
            values = [band_values(t, bands, rows_of) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array([v for x in values for v in x], pa.int64())], names=["p", "v"])

    buckets = distinct.mapInArrow(banded, "p bigint, v bigint")
    buckets = settle(buckets, "buckets")
    leads = buckets.groupBy("v").agg(F.min("p").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("v", "lead")
    live = settle(buckets.join(leads, "v"), "live")
    to_lead = live.where("p <> lead").select(F.col("lead").alias("a"), F.col("p").alias("b")).distinct()
    near = settle(_alike(to_lead, distinct, similarity), "near")
    marked = live.join(near.select(F.col("a").alias("lead"), F.col("b").alias("p"), F.lit(True).alias("near")), ["lead", "p"], "left")
    marked = marked.select("v", "p", (F.coalesce("near", F.lit(False)) | (F.col("p") == F.col("lead"))).alias("near"))
    odd = marked.where("NOT near").select("v").distinct()
    rest = group_pairs(marked.join(odd, "v", "left_semi"), ["v"], "p", ["near"], F.expr("NOT (near_l AND near_r)")).select("a", "b").distinct()
    rest = rest.join(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    links = near.unionByName(_alike(rest, distinct, similarity))
    cluster = components(settle(links, "links"))
    named = places.withColumn("p", F.xxhash64("_h")).join(cluster.withColumnRenamed("node", "p"), "p", "left").withColumn("cluster", F.coalesce("component", "p"))
    first = named.groupBy("cluster").agg(F.min(F.struct("doc", "off")).alias("_f"))
    kept = (F.col("doc") == F.col("_f.doc")) & (F.col("off") == F.col("_f.off"))
    return named.join(first, "cluster").select(F.col("doc").alias(key), "off", "n_chars", "cluster", kept.alias("kept"))


def _alike(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of (p, part) whose sets of word shingles have at least the similarity."""
    sides = pairs.join(texts.select(F.col("p").alias("a"), F.col("part").alias("x")), "a").join(texts.select(F.col("p").alias("b"), F.col("part").alias("y")), "b")

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s, t = word_shingles(x), word_shingles(y)
                both = len(s & t)
                ok.append(both >= similarity * (len(s) + len(t) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in range(2)], names=["a", "b"])

    return sides.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def removals(clusters: DataFrame, key: str) -> DataFrame:
    """(key, paragraphs, removed, removed_chars): what a record loses if of each cluster of paragraphs only the kept place stays."""
    gone = F.when(~F.col("kept"), F.col("n_chars"))
    return clusters.groupBy(key).agg(F.count(F.lit(1)).alias("paragraphs"), F.count(gone).alias("removed"), F.coalesce(F.sum(gone), F.lit(0)).cast("bigint").alias("removed_chars"))
