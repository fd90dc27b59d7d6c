"""Byte-level BPE over whole partitions by a pair occurrence index.

The distinct pre-tokens of a batch are laid out in one symbol array with links to the next and
previous symbol. An index maps every mergeable pair (by its rank) to all positions where it stands.
Ranks are taken in ascending order; all occurrences of a rank are merged at once, and the pairs that
arise beside the merged symbols join the lists of their own ranks, which are always higher, since a
pair with the new symbol can only have been ranked after the symbol itself.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import regex

#: The public split pattern of the vocabulary's rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens remembered between batches; beyond it the memory is emptied, which changes no result.
REMEMBER = 400_000


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed one."""
    if folder:
        return f"{folder}/{name}"
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


class PairIndexBPE:
    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.width = max(ranks.values()) + 1
        code: list[int] = []
        made: list[int] = []
        # A token's pair is the split into two tokens that the lower ranks alone would reach.
        for token, rank in ranks.items():
            if len(token) < 2:
                continue
            left, right = _split(token, rank, ranks)
            code.append(left * self.width + right)
            made.append(rank)
        order = np.argsort(np.array(code, dtype=np.int64))
        self.codes = np.array(code, dtype=np.int64)[order]
        self.made = np.array(made, dtype=np.int64)[order]
        by_rank = np.argsort(self.made)
        self.rank_list = self.made[by_rank]
        self.rank_code = self.codes[by_rank]
        self.split = regex.compile(PATTERN)
        self._forget()

    def _forget(self) -> None:
        """Two memories of ids: of pre-tokens, and of chunks, the stretches between lone spaces."""
        self.pieces = _Memory()
        self.chunks = _Memory()

    def _lookup(self, code: np.ndarray) -> np.ndarray:
        """Rank of each pair code, -1 where the pair can't be merged."""
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.made[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the offsets of each word in them."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(sym)
        ends = np.cumsum(lengths)
        nxt = np.arange(1, n + 1, dtype=np.int64)
        prv = np.arange(-1, n - 1, dtype=np.int64)
        if n:
            nxt[ends[lengths > 0] - 1] = -1
            prv[(ends - lengths)[lengths > 0]] = -1
        alive = np.ones(n, dtype=bool)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(pos: np.ndarray) -> None:
            pos = pos[pos >= 0]
            pos = pos[nxt[pos] >= 0]
            if not len(pos):
                return
            rank = self._lookup(sym[pos] * self.width + sym[nxt[pos]])
            pos, rank = pos[rank >= 0], rank[rank >= 0]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], cut))].tolist(), np.split(pos, cut), strict=True):
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(part)

        note(np.arange(n, dtype=np.int64))
        while heap:
            rank = heapq.heappop(heap)
            at = int(np.searchsorted(self.rank_list, rank))
            a, b = divmod(int(self.rank_code[at]), self.width)
            parts = lists.pop(rank)
            pos = np.unique(np.concatenate(parts))
            pos = pos[alive[pos] & (sym[pos] == a)]
            right = nxt[pos]
            ok = right >= 0
            pos, right = pos[ok], right[ok]
            ok = sym[right] == b
            pos, right = pos[ok], right[ok]
            if a == b and len(pos) > 1:
                # In a run of equal symbols every second occurrence overlaps the one before.
                new_run = np.concatenate(([True], right[:-1] != pos[1:]))
                first = np.maximum.accumulate(np.where(new_run, np.arange(len(pos)), 0))
                keep = (np.arange(len(pos)) - first) % 2 == 0
                pos, right = pos[keep], right[keep]
            if not len(pos):
                continue
            sym[pos] = rank
            alive[right] = False
            after = nxt[right]
            nxt[pos] = after
            prv[after[after >= 0]] = pos[after >= 0]
            before = prv[pos]
            # A neighbour on the left that was itself merged now starts at its own position.
            note(np.concatenate((before, pos)))
        ids = sym[alive].astype(np.int32)
        counts = np.concatenate(([0], np.cumsum(alive)))
        return ids, np.concatenate(([0], counts[ends])) if len(words) else np.zeros(1, dtype=np.int64)

    def _piece_ids(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each list of pre-tokens, and the lists' offsets in them."""
        known, fresh = self.pieces.at, []
        for pieces in lists:
            for p in pieces:
                if p not in known:
                    known[p] = len(known)
                    fresh.append(p)
        if fresh:
            self.pieces.extend(*self.merge([p.encode("utf-8", "surrogatepass") for p in fresh]))
        seq = np.fromiter((known[p] for pieces in lists for p in pieces), dtype=np.int64)
        ids, begin = self.pieces.gather(seq)
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return ids, begin[np.concatenate(([0], np.cumsum(counts)))]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array and the offsets of each text; null and empty texts have none.

        A space between two characters that are not white space always opens a pre-token, so the
        chunks between such spaces are encoded each on its own and remembered. A text with another
        kind of gap beside a space is split by the pattern as a whole and enters as one chunk.
        """
        if len(self.chunks.at) > REMEMBER or len(self.pieces.at) > REMEMBER:
            self._forget()
        known, fresh = self.chunks.at, []
        seq: list[int] = []
        ends = [0]
        for text in texts:
            if text:
                head, *rest = text.split(" ")
                keys = ["\0" + head, *rest]
                try:
                    if "\0" in text:  # the mark of a head can't be told from the text's own
                        raise KeyError
                    seq.extend([known[k] for k in keys])
                except KeyError:
                    if "\0" in text or any(not k or k[0].isspace() or k[-1].isspace() for k in rest) or head[-1:].isspace():
                        keys = ["\0" + text]
                    for k in keys:
                        if k not in known:
                            known[k] = len(known)
                            fresh.append(k)
                    seq.extend([known[k] for k in keys])
            ends.append(len(seq))
        if fresh:
            find = self.split.findall
            self.chunks.extend(*self._piece_ids([find(k[1:] if k[:1] == "\0" else " " + k) for k in fresh]))
        ids, begin = self.chunks.gather(np.array(seq, dtype=np.int64))
        return ids, begin[np.array(ends)]


class _Memory:
    """Id sequences by number: ``at`` gives the number of a key, the arrays its ids."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)

    def extend(self, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.start = np.concatenate((self.start, offsets[1:] + len(self.flat)))
        self.flat = np.concatenate((self.flat, ids))

    def gather(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered sequences one after the other, and the offset of each."""
        if not len(seq):
            return np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        length = self.start[seq + 1] - self.start[seq]
        begin = np.concatenate(([0], np.cumsum(length)))
        return self.flat[np.repeat(self.start[seq] - begin[:-1], length) + np.arange(begin[-1])], begin


def _split(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], rank), i))
        if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    if len(parts) != 2:
        raise ValueError(f"token {token!r} has no pair")
    return ranks[parts[0]], ranks[parts[1]]


_loaded: dict[str, PairIndexBPE] = {}


def load(path: str) -> PairIndexBPE:
    """One encoder per worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = PairIndexBPE(path)
    return _loaded[path]


def encoded_batches(batches, text: str, path: str) -> Iterator[tuple]:
    """(batch, ids, offsets) for each Arrow batch."""
    bpe = load(path)
    for batch in batches:
        ids, offsets = bpe.encode(batch.column(text).to_pylist())
        yield batch, ids, offsets
