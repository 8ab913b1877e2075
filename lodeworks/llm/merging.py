"""Exact BPE merging of many words side by side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_NONE = np.int32(2**31 - 1)


class MergeTable:
    """Pairs of token ids with their ranks and what they become, in an open hash table of arrays.

    ``merge`` joins, in every word, the leftmost pair of the lowest rank until no pair is left, as the library does.
    """

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.bits = max(4, (4 * len(merges)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int32)
        self.made = np.zeros(max((r for r, _ in merges.values()), default=0) + 1, np.int32)
        todo = np.array([(a << 32 | b, rank) for (a, b), (rank, _) in merges.items()], np.int64).reshape(-1, 2)
        for rank, new in merges.values():
            self.made[rank] = new
        at = self._place(todo[:, 0])
        while len(todo):
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1), return_index=True)
            first = first[free[first]]
            self.keys[at[first]], self.ranks[at[first]] = todo[first, 0], todo[first, 1]
            left = np.ones(len(todo), bool)
            left[first] = False
            todo, at = todo[left], (at[left] + 1) & (size - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; the highest number for pairs that do not join or that hold a negative id."""
        keys = a.astype(np.int64) << 32 | b
        at = self._place(keys)
        found = self.keys[at]
        hit = found == keys
        out = np.where(hit, self.ranks[at], _NONE)
        todo = np.flatnonzero(~hit & (found >= 0))
        keys, at = keys[todo], (at[todo] + 1) & (len(self.keys) - 1)
        while len(todo):
            found = self.keys[at]
            hit = found == keys
            out[todo[hit]] = self.ranks[at[hit]]
            go = ~hit & (found >= 0)
            todo, keys, at = todo[go], keys[go], (at[go] + 1) & (len(self.keys) - 1)
        return out

    def merge(self, start: np.ndarray) -> np.ndarray:
        """Merged ids of rows of equally long words; a place joined to what is left of it holds -1.

        Places are linked to their neighbours, and a place without an id stands at each end, so a join changes four
        places of a row however long the row is.
        """
        n, width = start.shape
        out = start.astype(np.int32)
        if width < 2 or not n:
            return out
        span = width + 2
        ids = np.full((n, span), -1, np.int32)
        ids[:, 1:-1] = out
        ranks = np.full((n, span), _NONE, np.int32)
        ranks[:, 1:width] = self.rank(out[:, :-1].ravel(), out[:, 1:].ravel()).reshape(n, width - 1)
        after, before = (np.tile(np.arange(span, dtype=np.int32) + by, (n, 1)) for by in (1, -1))
        rows = np.arange(n)
        while True:
            p = ranks.argmin(axis=1)
            own = np.arange(len(rows)) * span
            best = ranks.ravel()[own + p]
            live = best != _NONE
            going = int(np.count_nonzero(live))
            if 4 * going < 3 * len(rows):
                done = ~live
                out[rows[done]] = ids[done, 1:-1]
                if not going:
                    return out
                ids, ranks, after, before, rows, p, best = (x[live] for x in (ids, ranks, after, before, rows, p, best))
                own = own[:going]
            elif going < len(rows):
                own, p, best = own[live], p[live], best[live]
            flat, rank, right, left = ids.ravel(), ranks.ravel(), after.ravel(), before.ravel()
            here, new = own + p, self.made[best]
            gone = own + right[here]
            far, near = right[gone], own + left[here]
            beyond = own + far
            flat[here], flat[gone], rank[gone] = new, -1, _NONE
            right[here], left[beyond] = far, p
            both = self.rank(np.concatenate([new, flat[near]]), np.concatenate([flat[beyond], new]))
            rank[here], rank[near] = both[:going], both[going:]


def merge_column(table: MergeTable, words: pa.Array, first: np.ndarray, last: np.ndarray, kind: str, longest: int = 48) -> pa.Array:
    """Packed ids of each word of a column of strings or binaries without nulls.

    ``first`` and ``last`` give the ids of a byte inside a word and at its end. Words over ``longest`` bytes are left to
    the caller (null).
    """
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    if not len(words):
        return pa.array([], pa.large_binary())
    begins = np.frombuffer(offsets, np.int64, len(words) + 1, words.offset * 8)
    lengths = np.diff(begins)
    raw = np.frombuffer(data or b"", np.uint8)
    order = np.argsort(lengths, kind="stable")
    widths, at = np.unique(lengths[order], return_index=True)
    counts, pieces = np.zeros(len(words), np.int64), []
    for width, lo, hi in zip(widths.tolist(), at.tolist(), [*at[1:].tolist(), len(words)], strict=True):
        if not 0 < width <= longest:
            continue
        letters = raw[begins[order[lo:hi], None] + np.arange(width)]
        start = first[letters]
        start[:, -1] = last[letters[:, -1]]
        merged = table.merge(start)
        kept = merged >= 0
        pieces.append(merged[kept].astype(kind))
        counts[lo:hi] = np.count_nonzero(kept, axis=1)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(counts * np.dtype(kind).itemsize)])
    packed = np.concatenate(pieces) if pieces else np.zeros(0, kind)
    sorted_ids = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
    places = np.empty(len(words), np.int64)
    places[order] = np.arange(len(words))
    return sorted_ids.take(pa.array(places, mask=lengths > longest))


def merge_words(table: MergeTable, words: list[bytes], first: np.ndarray, last: np.ndarray, kind: str, longest: int = 48) -> list[bytes | None]:
    """``merge_column`` of a list of words."""
    return merge_column(table, pa.array(words, pa.large_binary()), first, last, kind, longest).to_numpy(zero_copy_only=False).tolist()
