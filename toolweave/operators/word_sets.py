"""Overlaps of sets of words: one side as an index held in a task, the other in Arrow batches that pass by it.

Words are numbered by their frequency in the held side, rare ones first; words that it lacks count only for
a set's size and stand before all others. A pair whose Jaccard similarity is above t shares more than
t / (1 + t) * (m + n) words, m and n the sizes. Its first common word leaves at least so many in both sets, which
bounds the places in both prefixes (prefix and position filter); a sketch of 512 bits bounds the
overlap of the pairs that meet, and the rest are counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Meetings or pairs that a task handles in one step.
STEP = 1 << 20
BITS = 512
SLACK = 1e-9


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in it) for groups of the given sizes, one after the other."""
    total = int(counts.sum())
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def steps(counts: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Ranges of groups with about ``most`` members, one group at least."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


class Grouped:
    """Members by group number, for numbers from 0."""

    def __init__(self, group: np.ndarray, groups: int, member: np.ndarray | None = None):
        order = np.argsort(group, kind="stable")
        self.member = order if member is None else member[order]
        self.count = np.bincount(group, minlength=groups)
        self.start = np.cumsum(self.count) - self.count

    def of(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``asked``, member) of all members of the groups asked for."""
        who, place = spread(self.count[asked])
        return who, self.member[self.start[asked][who] + place]


def distinct_words(texts: pa.Array) -> pa.ListArray:
    """The distinct words of each text, between characters of Java's ``\\s``; their values are dictionary-encoded."""
    parts = pc.ascii_split_whitespace(texts)
    word = parts.flatten().dictionary_encode()
    width = max(1, len(word.dictionary))
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    # By text, then by word: a word that stands twice in a text counts once, and nothing before or after a space is no word.
    code = np.unique(row * width + word.indices.to_numpy(zero_copy_only=False))
    row, ids = code // width, code % width
    some = (pc.binary_length(word.dictionary).to_numpy(zero_copy_only=False) > 0)[ids]
    offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[some], minlength=len(texts))))), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.DictionaryArray.from_arrays(pa.array(ids[some], pa.int32()), word.dictionary))


class Sets:
    """The distinct sets of a list column: sizes, known words as ascending numbers, the rows of each set. With
    ``list_of`` the rows are its members, and each has the list that stands at that place."""

    def __init__(self, words: pa.ListArray, vocabulary: pa.Array, list_of: np.ndarray | None = None):
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = words.flatten()
        coded = pa.types.is_dictionary(flat.type)
        at = pc.index_in(flat.dictionary, value_set=vocabulary).take(flat.indices) if coded else pc.index_in(flat, value_set=vocabulary)
        known = pc.is_valid(at).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(words)), sizes)[known]
        width = max(1, len(vocabulary))
        code = np.sort(row * width + at.drop_null().to_numpy(zero_copy_only=False))
        ids, n_known = (code % width).astype(np.int32), np.bincount(row, minlength=len(words))
        ends = np.cumsum(n_known)
        # Sets that agree in size and in the known words have the same overlaps.
        seen: dict[tuple[int, bytes], int] = {}
        self.set_of = np.fromiter((seen.setdefault((int(sizes[i]), ids[ends[i] - n_known[i] : ends[i]].tobytes()), len(seen)) for i in range(len(words))), np.int64, len(words))
        first = np.unique(self.set_of, return_index=True)[1]
        if list_of is not None:
            self.set_of = self.set_of[list_of]
        self.rows = Grouped(self.set_of, len(first))
        self.size, self.known = sizes[first], n_known[first]
        owner, place = spread(self.known)
        self.owner, self.place, self.ids = owner, place, ids[(ends - n_known)[first][owner] + place].astype(np.int64)
        self.start = np.cumsum(self.known) - self.known
        bits = np.zeros((len(first), BITS), dtype=bool)
        bits[owner, self.ids % BITS] = True
        self.bits = np.packbits(bits, axis=1).view(np.uint64)

    def prefix(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set, word, place in the whole set) of the words of which a pair above the threshold shares one."""
        place = self.place + (self.size - self.known)[self.owner]
        ok = place < (self.size - np.ceil(threshold * self.size) + 1)[self.owner]
        return self.owner[ok], self.ids[ok], place[ok]


class Index:
    """The held side. ``names`` may be null or absent."""

    def __init__(self, keys: pa.Array, words: pa.ListArray, names: pa.Array | None, threshold: float):
        counted = words.flatten().value_counts()
        order = np.argsort(counted.field("counts").to_numpy(), kind="stable")
        self.vocabulary = counted.field("values").take(pa.array(order))
        self.keys, self.threshold = keys, threshold
        self.sets = Sets(words, self.vocabulary)
        self.width = max(1, len(self.vocabulary))
        self.codes = self.sets.owner * self.width + self.sets.ids
        who, word, place = self.sets.prefix(threshold)
        self.posts = Grouped(word, self.width)
        self.post_set, self.post_place = who[self.posts.member], place[self.posts.member]
        self.names = None
        if names is not None:
            self.names = names.drop_null().unique()
            code = pc.index_in(names, value_set=self.names, skip_nulls=True)
            row = np.nonzero(pc.is_valid(code).to_numpy(zero_copy_only=False))[0]
            self.named = Grouped(code.drop_null().to_numpy(zero_copy_only=False), len(self.names), row)

    def similarity(self, x: np.ndarray, y: np.ndarray, other: Sets) -> np.ndarray:
        """The Jaccard similarity of held set x and other set y; 0 where both are empty."""
        value = np.zeros(len(x))
        for at, to in steps(other.known[y]):
            who, place = spread(other.known[y[at:to]])
            code = x[at:to][who] * self.width + other.ids[other.start[y[at:to]][who] + place]
            found = np.searchsorted(self.codes, code)
            hit = self.codes[np.minimum(found, len(self.codes) - 1)] == code if len(self.codes) else np.zeros(len(code), dtype=bool)
            same = np.bincount(who[hit], minlength=to - at)
            value[at:to] = same / np.maximum(1, self.sets.size[x[at:to]] + other.size[y[at:to]] - same)
        return value

    def meet(self, other: Sets) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(held set, other set, similarity) of the pairs above the threshold, each once."""
        share = self.threshold / (1 + self.threshold)
        set_y, word, place_y = other.prefix(self.threshold)
        met = self.posts.count[word]
        for first, last in steps(np.bincount(set_y, weights=met, minlength=len(other.size)).astype(np.int64)):
            # All words of a set are looked at in one step, so a pair comes up in one step only.
            lo, hi = np.searchsorted(set_y, (first, last))
            who, nth = spread(met[lo:hi])
            post = self.posts.start[word[lo:hi]][who] + nth
            x, y = self.post_set[post], set_y[lo:hi][who]
            m, n = self.sets.size[x], other.size[y]
            ok = np.minimum(m - self.post_place[post], n - place_y[lo:hi][who]) > share * (m + n) - SLACK
            code = np.unique(y[ok] * len(self.sets.size) + x[ok])
            x, y = code % max(1, len(self.sets.size)), code // max(1, len(self.sets.size))
            m, n = self.sets.size[x], other.size[y]
            most = np.minimum(m - self._missing(self.sets.bits, x, other.bits, y), other.known[y] - self._missing(other.bits, y, self.sets.bits, x))
            ok = most > share * (m + n) - SLACK
            x, y = x[ok], y[ok]
            value = self.similarity(x, y, other)
            ok = value > self.threshold
            yield x[ok], y[ok], value[ok]

    @staticmethod
    def _missing(one: np.ndarray, i: np.ndarray, two: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(one[i, k] & ~two[j, k]).astype(np.int64) for k in range(one.shape[1]))

    def pairs(self, keys: pa.Array, texts: pa.Array, names: pa.Array | None) -> Iterator[pa.RecordBatch]:
        """(a, b, similarity) of held rows a and rows b of the batch: above the threshold, or of one name."""
        text = texts.dictionary_encode()
        other = Sets(distinct_words(text.dictionary), self.vocabulary, text.indices.to_numpy(zero_copy_only=False))
        for x, y, value in self.meet(other):
            for at, to in steps(self.sets.rows.count[x] * other.rows.count[y]):
                who, a = self.sets.rows.of(x[at:to])
                again, b = other.rows.of(y[at:to][who])
                yield self._batch(keys, a[again], b, value[at:to][who][again])
        if self.names is None:
            return
        code = pc.index_in(names, value_set=self.names, skip_nulls=True)
        row = np.nonzero(pc.is_valid(code).to_numpy(zero_copy_only=False))[0]
        code = code.drop_null().to_numpy(zero_copy_only=False)
        for at, to in steps(self.named.count[code]):
            who, a = self.named.of(code[at:to])
            b = row[at:to][who]
            value = self.similarity(self.sets.set_of[a], other.set_of[b], other)
            ok = ~(value > self.threshold)
            yield self._batch(keys, a[ok], b[ok], value[ok])

    def _batch(self, keys: pa.Array, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        a, b = self.keys.take(pa.array(a)), keys.take(pa.array(b))
        batch = pa.RecordBatch.from_arrays([a, b, pa.array(value)], names=["a", "b", "similarity"])
        return batch.filter(pc.not_equal(a, b))
