"""Tool lists of whole conversations, many at a time, in Arrow batches of their needed tools in order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from toolweave.operators.word_sets import Grouped

SOURCES = pa.array(["truth", "similar", "random"])


def groups(column: pa.ChunkedArray) -> np.ndarray:
    """The first row of each run of equal values; nulls are equal."""
    code = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate(([0], np.nonzero(np.diff(code))[0] + 1))


def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The same rows, sorted by their first column, cut only between two values of it."""
    rest = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            last = int(groups(table.column(0))[-1])
            if last:
                yield table.slice(0, last)
            rest = table.slice(last)
    if rest is not None:
        yield rest


class Near:
    """Pool tools near the needed ones, the most similar first and ties by the key, and the tools that fill a list."""

    def __init__(self, query: pa.Array, key: pa.Array, similarity: np.ndarray, drawn: pa.Array):
        known = pa.chunked_array([query, key, drawn]).unique()
        self.known = known.take(pc.array_sort_indices(known))
        self.drawn, self.width = drawn, len(self.known)
        query, key, drawn = (self.code(x) for x in (query, key, drawn))
        order = np.lexsort((key, -similarity))
        self.key = key[order]
        self.of_query = Grouped(query[order], self.width)
        self.drawn_at = np.full(self.width + 1, -1)
        self.drawn_at[drawn] = np.arange(len(drawn))

    def code(self, keys: pa.Array) -> np.ndarray:
        """The number of each key, in the keys' order; ``width`` for one that is neither near any nor drawn."""
        return pc.fill_null(pc.index_in(keys, value_set=self.known, skip_nulls=True), self.width).to_numpy(zero_copy_only=False).astype(np.int64)

    def lists(self, conversations: pa.Array, keys: pa.Array, starts: np.ndarray, similar: int, total: int) -> pa.RecordBatch:
        """(conv_id, key, source, rank) of the conversations that begin at ``starts``, by their needed keys in order."""
        count = np.diff(np.append(starts, len(keys)))
        conv = np.repeat(np.arange(len(starts)), count)
        rank, own = np.arange(len(keys)) - starts[conv] + 1, self.code(keys)
        # The near tools of all needed ones; of a tool that comes up several times the first place counts, and none if it is needed itself.
        asks = np.nonzero((count[conv] < similar) & (own < self.width))[0]
        who, row = self.of_query.of(own[asks])
        base = len(self.key) + 1
        mine = np.nonzero(own < self.width)[0]
        met = np.sort(np.concatenate(((conv[asks][who] * self.width + self.key[row]) * base + row + 1, (conv[mine] * self.width + own[mine]) * base)))
        pair, row = met // base, met % base
        best = (row > 0) & (np.diff(pair, prepend=-1) != 0)
        placed = np.sort(pair[best] // self.width * base + row[best] - 1)
        near_conv, near = placed // base, self.key[placed % base]
        place = np.arange(len(placed)) - np.searchsorted(near_conv, near_conv)
        ok = place < similar - count[near_conv]
        near_conv, near, near_rank = near_conv[ok], near[ok], (count[near_conv] + place + 1)[ok]
        # The tools drawn fill what is left, but for those that the list has.
        have = np.zeros((len(starts), len(self.drawn)), dtype=bool)
        for c, k in ((conv, own), (near_conv, near)):
            at = self.drawn_at[k]
            have[c[at >= 0], at[at >= 0]] = True
        size = count + np.bincount(near_conv, minlength=len(starts))
        nth = np.cumsum(~have, axis=1)
        fill_conv, fill = np.nonzero(~have & (nth <= (total - size)[:, None]))
        fill_rank = size[fill_conv] + nth[fill_conv, fill]
        cut, near_cut = rank <= total, near_rank <= total
        parts = (conv[cut], near_conv[near_cut], fill_conv)
        key = pa.concat_arrays([keys.filter(pa.array(cut)), self.known.take(pa.array(near[near_cut])), self.drawn.take(pa.array(fill))])
        source = SOURCES.take(pa.array(np.repeat(np.arange(3), [len(x) for x in parts])))
        ranks = np.concatenate((rank[cut], near_rank[near_cut], fill_rank)).astype(np.int32)
        return pa.RecordBatch.from_arrays([conversations.take(pa.array(starts[np.concatenate(parts)])), key, source, pa.array(ranks)], names=["conv_id", "key", "source", "rank"])


def near_of(rows: pa.Table, drawn: pa.Array) -> Near:
    """The neighbours that travel with the needed tools in column 2, each tool's once."""
    keys, near = rows.column(2).combine_chunks(), rows.column(3).combine_chunks()
    first = np.sort(np.unique(keys.dictionary_encode(null_encoding="encode").indices.to_numpy(), return_index=True)[1])
    keys, near = keys.take(pa.array(first)), near.take(pa.array(first))
    found = near.flatten()
    sizes = pc.fill_null(pc.list_value_length(near), 0).to_numpy(zero_copy_only=False)
    return Near(keys.take(pa.array(np.repeat(np.arange(len(keys)), sizes))), found.field("key"), found.field("similarity").to_numpy(), drawn)
