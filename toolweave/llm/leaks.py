"""Evaluation passages inside training texts, by q-gram lemma filtering (problem 4).

Texts and items are brought to their words, lower-case ASCII letters and digits with one space between
them. A passage of ``words`` words of which at most ``edits`` are replaced, left out or joined by others falls
into at most ``edits`` + 1 stretches that stand in the text as they are. By the q-gram lemma these hold a known least number of the
item's q-grams, and the largest stretch its share of them inside one band of diagonals. Shared q-grams are
counted per item and band, the bands overlap by half, regions at the bound are kept and verified by an
alignment of the words inside a band as wide as the edits allow.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a q-gram: no longer than the shortest passage of 15 words of one letter each.
Q = 24
#: Characters of items held by every task at a time; a larger set is searched in passes.
MAX_ITEM_CHARS = 50_000_000
#: Characters whose q-grams are held at once.
SLICE_CHARS = 3_000_000
_ODD = 0x100000001B3
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def word_text(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts as words between single spaces, and the offset of each text. A text starts
    and ends with a space, so that words can be compared as wholes."""
    sep = b"\xff"
    raw = sep.join(t.encode("utf-8", "replace").replace(sep, b" ") for t in texts) + sep if texts else b""
    b = np.frombuffer(raw.translate(_TABLE[:255] + sep), dtype=np.uint8)
    space = b == 32
    end = b == 255
    gap = space | end
    before_gap = np.concatenate(([True], gap[:-1]))
    # Of each run of gaps one space stays; the end of a text is a space too.
    keep = ~space | ~before_gap
    keep[end] = True
    out = np.where(end, 32, b)[keep]
    ends = np.flatnonzero(end[keep]) + 1
    return out.astype(np.uint8), np.concatenate(([0], ends))


def qgrams(b: np.ndarray, q: int) -> np.ndarray:
    cur, cur_len, res, res_len, rest = b.astype(np.uint64) + np.uint64(1), 1, None, 0, q
    n_all = len(b)
    while rest:
        shift = np.uint64(pow(_ODD, cur_len, 1 << 64))
        if rest & 1:
            if res is None:
                res, res_len = cur, cur_len
            else:
                n = max(0, n_all - res_len - cur_len + 1)
                res = res[:n] * shift + cur[res_len : res_len + n]
                res_len += cur_len
        rest >>= 1
        if rest:
            n = max(0, n_all - 2 * cur_len + 1)
            cur = cur[:n] * shift + cur[cur_len : cur_len + n]
            cur_len *= 2
    res = res * np.uint64(0x9E3779B97F4A7C15)
    return res ^ (res >> np.uint64(31))


class ItemIndex:
    """q-grams of the items: a bit table for the first test, then sorted hashes with item and place."""

    def __init__(self, items: list[tuple[int, str]], words: int, edits: int, q: int):
        self.ids = [i for i, _ in items]
        # The longest stretch left as it is has this many words of one letter or more.
        q = min(q, 2 * -(-(words - edits) // (edits + 1)) - 1)
        if q < 2:
            raise ValueError(f"{edits} edits leave too little of {words} words")
        self.words, self.edits, self.q = words, edits, q
        b, at = word_text([t or "" for _, t in items])
        self.text = [b[at[k] : at[k + 1]].tobytes().strip() for k in range(len(items))]
        self.parts = [t.split() for t in self.text]
        hashes, item, place = [], [], []
        self.bound = []
        for k, t in enumerate(self.text):
            x = np.frombuffer(t, dtype=np.uint8)
            h = qgrams(x, q) if len(x) >= q else np.zeros(0, dtype=np.uint64)
            hashes.append(h)
            item.append(np.full(len(h), k))
            place.append(np.arange(len(h)))
            self.bound.append(self._least_shared([len(p) for p in self.parts[k]]))
        self.bound = np.array(self.bound)
        h, i, p = np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(item or [[]]).astype(np.int64), np.concatenate(place or [[]]).astype(np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.place = h[order], i[order], p[order]
        self.bits = 20
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[(self.h >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def _least_shared(self, lengths: list[int]) -> int:
        """q-grams that the largest stretch of any passage shares with a text that holds it."""
        least = 1 << 30
        for k in range(len(lengths) - self.words + 1):
            part = lengths[k : k + self.words]
            edited = sum(sorted(part)[len(part) - self.edits :]) + 2 * self.edits if self.edits else 0
            shared = sum(part) + len(part) - 1 - edited - (self.edits + 1) * (self.q - 1)
            least = min(least, max(1, -(-shared // (self.edits + 1))))
        return least

    def search(self, texts: list[str]) -> list[tuple[int, int]]:
        """(text number, item id) of the leaks, each once."""
        b, at = word_text(texts)
        if len(b) < self.q or not len(self.h):
            return []
        h = qgrams(b, self.q)
        pos = np.flatnonzero(self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        low = np.searchsorted(self.h, h[pos], side="left")
        count = np.searchsorted(self.h, h[pos], side="right") - low
        pos, low, count = pos[count > 0], low[count > 0], count[count > 0]
        if not len(pos):
            return []
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        pos = np.repeat(pos, count)
        item, place = self.item[entry], self.place[entry]
        text = np.searchsorted(at, pos, side="right") - 1
        band = max(2, 2 * (self.edits + 1))
        # Each diagonal lies in two bands that overlap by half.
        cell = (pos - place) // (band // 2)
        key = np.concatenate((np.stack((text, item, cell), 1), np.stack((text, item, cell - 1), 1)))
        region, of, n = np.unique(key, axis=0, return_inverse=True, return_counts=True)
        ok = n >= self.bound[region[:, 1]]
        hit = np.flatnonzero(ok[of.reshape(-1)]) % len(pos)
        gaps = np.flatnonzero(b == 32)
        # The word in which a q-gram starts, or which follows if it starts with a space.
        word = np.searchsorted(gaps, pos[hit], side="right")
        tried = np.unique(np.stack((text[hit], item[hit], word - self._word(item[hit], place[hit])), 1), axis=0)
        found = set()
        for t, i, d in tried.tolist():
            if (t, i) not in found and self._aligned(b, gaps, int(at[t]), int(at[t + 1]), i, d):
                found.add((t, i))
        return [(t, self.ids[i]) for t, i in sorted(found)]

    def _word(self, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The number of the item's word in which a q-gram starts, or which follows if it starts with a space."""
        return np.array([self.text[i].count(b" ", 0, p + 1) for i, p in zip(item.tolist(), place.tolist(), strict=True)], dtype=np.int64)

    def _aligned(self, b: np.ndarray, gaps: np.ndarray, lo: int, hi: int, item: int, diagonal: int) -> bool:
        """Whether ``words`` consecutive words of the item stand in the text from lo to hi with at most ``edits`` edits,
        where word n of the item is near word n + ``diagonal`` of all texts."""
        mine, k = self.parts[item], self.edits
        first = int(np.searchsorted(gaps, lo)), int(np.searchsorted(gaps, hi))
        low, high = max(first[0], diagonal - k), min(first[1], diagonal + len(mine) + k)
        if high <= low:
            return False
        start = lo if low == first[0] else int(gaps[low - 1]) + 1
        said = [b""] * (low - diagonal + k) + b[start : int(gaps[high - 1])].tobytes().split(b" ")
        said += [b""] * (len(mine) + 2 * k - len(said))
        # said[n + k] is the word on the diagonal of word n; an empty one stands for none.
        if not k:
            run = 0
            for x, y in zip(mine, said, strict=True):
                run = run + 1 if x == y else 0
                if run >= self.words:
                    return True
            return False
        for a in range(len(mine) - self.words + 1):
            cost = [0] * (2 * k + 1)
            for n in range(a, a + self.words):
                then = [c + (mine[n] != said[n + o]) for o, c in enumerate(cost)]
                then = [min(c, cost[o + 1] + 1) if o < 2 * k else c for o, c in enumerate(then)]
                for o in range(1, 2 * k + 1):
                    then[o] = min(then[o], then[o - 1] + 1)
                cost = then
                if min(cost) > k:
                    break
            else:
                return True
        return False


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(start, texts): consecutive texts of about ``most`` characters together, so that the arrays over their
    characters stay small; a longer text is a slice of its own."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if k > start and size + len(t) > most:
            yield start, texts[start:k]
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def json_strings(raw: str | None) -> list[str]:
    """All strings inside a JSON text, names of members too; text that is JSON again is opened as well.
    Unreadable, blank or null text has none."""
    if not raw or not raw.strip():
        return []
    try:
        node = json.loads(raw)
    except (ValueError, RecursionError):
        return []
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            if x[:1] in "[{\"" and len(x) > 2 and x is not raw:
                try:
                    todo.append(json.loads(x))
                except (ValueError, RecursionError):
                    pass
        elif isinstance(x, list):
            todo.extend(x)
        elif isinstance(x, dict):
            out.extend(x)
            todo.extend(x.values())
    return out


def leaked_items(items: DataFrame, item: str, item_text: str, corpus: DataFrame, key: str, text: str, words: int = 15, nested: bool = False, edits: int = 0, q: int = Q) -> DataFrame:
    """(item, key): items of which ``words`` consecutive words stand consecutively in a text, repeats possible.

    Words are maximal runs of ASCII letters and digits in lower case. With ``nested`` a text is JSON and
    each string inside it is searched on its own. The items, a query set, go to every task, at most MAX_ITEM_CHARS at a time:
    a larger set takes several passes over the corpus, which is only mapped over. Null and empty texts hold nothing; an item with
    fewer words, or null, is never found. With ``edits`` above 0 as many words of a passage may be replaced,
    left out or stand between the others; q-grams are then shorter, so that none such is missed.
    """
    size = items.selectExpr(f"coalesce(sum(length(`{item_text}`)), 0) AS n").first()[0]
    passes = max(1, -(-int(size) // MAX_ITEM_CHARS))
    parts = [items.where(F.pmod(F.xxhash64(item), F.lit(passes)) == n) if passes > 1 else items for n in range(passes)]
    return reduce(DataFrame.unionByName, [_searched(p, item, item_text, corpus, key, text, words, nested, edits, q) for p in parts])


def _searched(items: DataFrame, item: str, item_text: str, corpus: DataFrame, key: str, text: str, words: int, nested: bool, edits: int, q: int) -> DataFrame:
    held = [(r[0], r[1]) for r in items.select(item, item_text).where(f"`{item}` IS NOT NULL").distinct().collect()]
    spark = corpus.sparkSession
    sent = spark.sparkContext.broadcast(held)
    made: list[ItemIndex] = []
    kinds = items.schema[item].dataType.simpleString(), corpus.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            if not made:
                made.append(ItemIndex(sent.value, words, edits, q))
            raw = batch.column(1).to_pylist()
            if nested:
                texts, owner = [], []
                for k, x in enumerate(raw):
                    for t in dict.fromkeys(json_strings(x)):
                        if len(t) >= 2 * words - 1:
                            texts.append(t)
                            owner.append(k)
            else:
                owner = [k for k, x in enumerate(raw) if x]
                texts = [raw[k] for k in owner]
            hits = list(dict.fromkeys((owner[t + at], i) for at, part in slices(texts) for t, i in made[0].search(part)))
            yield pa.RecordBatch.from_arrays([pa.array([i for _, i in hits], pa.from_numpy_dtype("int64")), batch.column(0).take(pa.array([k for k, _ in hits], pa.int64()))], names=[item, key])

    return corpus.select(key, text).mapInArrow(run, f"`{item}` {kinds[0]}, `{key}` {kinds[1]}")
