"""Periodic runs of words: repeated k-grams mask a text, Main and Lorentz's division finds the runs in what survives.

A run is a stretch of words with smallest period q and at least ``max(6, 4 q)`` words that no neighbour extends. Words q
apart are equal along all but q of its words, so at least ``min over q of max(6, 4 q) - q = 5`` words in a row repeat q
words on, and, as a run is at least twice that stretch's distance long, each of its words lies in a 5-gram that occurs
again in the text. Words outside repeated 5-grams can't join runs; what survives falls into segments, and a run lies in
one of them. 5-grams are counted by 64-bit hashes; two that share one only let words survive that needn't.

Segments are halved again and again. A run is met at the first cut that goes through it, with at least two periods on
one side of the cut: for a period q, words left and right of the cut are compared with the words q on (or q back) as far
as they agree in both directions, and that stretch is the run. All cuts of a depth, of all texts of a batch, are
compared together, by names of stretches of 1, 2, 4, … words (prefix doubling), so every comparison is exact. A stretch
found with several periods has the smallest of them.

Defined cases: a null text or one without words has no run and collapses to the empty text; a row without an id takes
part, and none of its words is rewritten by ``planted``; repeated rows are rows of their own; a text of any length is
taken whole (names are kept for stretches of up to 65 536 words, longer ones are compared step by step, so memory is some
100 bytes a word); an empty table gives no rows; columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm import common

LEAST, TIMES = 6, 4
#: The words in a row that the shortest run of any period shows twice.
GRAM = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST))
_LEVELS = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def segments(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of words (numbered ``ids``, of texts ``doc``) that lie in 5-grams found again in their text."""
    n = len(ids) - GRAM + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = doc[:n].astype(np.uint64) * _ODD
    for i in range(GRAM):
        h = _mix((h ^ ids[i : n + i].astype(np.uint64)) * _ODD + np.uint64(i))
    whole = np.flatnonzero(doc[:n] == doc[GRAM - 1 :])  # 5-grams do not reach into the next text
    order = whole[np.argsort(h[whole], kind="stable")]
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[at] += 1
    edge[at + GRAM] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    change = np.ones(len(ids), bool)
    change[1:] = (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])
    begins = np.flatnonzero(change)
    ends = np.append(begins[1:], len(ids))
    keep = inside[begins] & (ends - begins >= LEAST)
    return begins[keep], ends[keep]


class Names:
    """Names of the stretches of 2^j words at each place of a sequence: equal names, equal words."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.levels = [ids.astype(np.int32)]
        while len(self.levels) <= _LEVELS and 2 << len(self.levels) <= longest:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            if len(last) <= step:
                break
            pair = last[:-step].astype(np.int64) << 32 | last[step:]
            self.levels.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))

    def ahead(self, a: np.ndarray, b: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and ``b`` (a < b) on agree, before ``end`` of the later one."""
        return self._common(a, b, end - b, 1)

    def back(self, a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words before ``a`` and ``b`` agree, from ``begin`` of the earlier one."""
        return self._common(a, b, a - begin, -1)

    def _common(self, a: np.ndarray, b: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
        total = np.zeros(len(a), np.int64)
        going = np.arange(len(a))
        top = len(self.levels) - 1
        while len(going):  # longer than the longest names: on by these, as far as they agree
            going = self._step(total, going, a, b, room, way, top)
        for j in range(top - 1, -1, -1):
            self._step(total, np.arange(len(a)), a, b, room, way, j)
        return total

    def _step(self, total: np.ndarray, going: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, way: int, j: int) -> np.ndarray:
        size, names = 1 << j, self.levels[j]
        going = going[total[going] + size <= room[going]]
        shift = total[going] if way > 0 else -total[going] - size
        going = going[names[a[going] + shift] == names[b[going] + shift]]
        total[going] += size
        return going


def runs(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of the runs within segments of a sequence of word numbers, by start, then period."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(begins):
        names = Names(ids, int((ends - begins).max()))
    low, high, seg = begins, ends, np.arange(len(begins))
    while len(low):
        cut = (low + high) // 2
        periods = (high - low) // TIMES  # a run within the part has no greater one
        q = np.arange(periods.sum()) - np.repeat(np.cumsum(periods) - periods, periods) + 1
        part = np.repeat(np.arange(len(low)), periods)
        mid, first, last = cut[part], begins[seg[part]], ends[seg[part]]
        level = np.minimum(np.int64(np.log2(q)), len(names.levels) - 1)
        # two periods on the right of the cut: the q words there equal the next q; or on the left
        for a, b in ((mid, mid + q), (mid - q, mid)):
            look = a if a is mid else a - q  # where q equal words must begin
            ok = np.flatnonzero((look >= first) & (look + 2 * q <= last))
            for j in np.unique(level[ok]).tolist():
                at = ok[level[ok] == j]
                at = at[names.levels[j][look[at]] == names.levels[j][look[at] + q[at]]]
                ahead, back = names.ahead(a[at], b[at], last[at]), names.back(a[at], b[at], first[at])
                length = ahead + back + q[at]
                long = length >= np.maximum(LEAST, TIMES * q[at])
                found.append((a[at][long] - back[long], length[long], q[at][long]))
        low, high, seg = np.concatenate([low, cut]), np.concatenate([cut, high]), np.concatenate([seg, seg])
        more = high - low >= LEAST
        low, high, seg = low[more], high[more], seg[more]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Counts of words of each text (null: none), and all words one after the other."""
    cut = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[\x20\x09-\x0D]+")
    flat, parents = cut.flatten(), pc.list_parent_indices(cut).to_numpy()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    return np.bincount(parents[full], minlength=len(texts)), flat.filter(pa.array(full))


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places from which a rewritten text takes its words, None for texts left as they are."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _found(rewrite: Callable[[int | None, int], np.ndarray | None] | None, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            doc_ids = rows.column(0).to_pylist()
            sizes, words = words_of(rows.column(1))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            taken = np.arange(len(words))
            for i, doc_id in enumerate(doc_ids if rewrite else []):
                if (own := rewrite(doc_id, int(sizes[i]))) is not None:
                    taken[offsets[i] : offsets[i + 1]] = offsets[i] + own
            ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)[taken] if len(words) else np.zeros(0, np.int64)
            doc = np.repeat(np.arange(len(doc_ids)), sizes)
            start, length, period = _runs_of(ids, doc)
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            kept = np.cumsum(edge[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=len(doc_ids)))])
            collapsed = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left, pa.int64()), words.take(pa.array(taken[kept]))), pa.scalar(" ", pa.large_string()))
            of = np.searchsorted(start, offsets)  # runs are in the order of the texts
            out: list[tuple] = []
            for i, doc_id in enumerate(doc_ids):
                own = slice(of[i], of[i + 1])
                s, n, q = (start[own] - offsets[i]).tolist(), length[own].tolist(), period[own].tolist()
                best = min(zip((-x for x in n), s, q, strict=True), default=None)
                digest = hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in zip(s, n, q, strict=True)).encode()).hexdigest()
                text = collapsed[i].as_buffer()
                lead = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
                out.append((doc_id, len(s), *lead, digest, hashlib.sha256(text if text is not None else b"").hexdigest(), *([(text.to_pybytes().decode() if text is not None else ""), [{"start": x, "length": y, "period": z} for x, y, z in zip(s, n, q, strict=True)]] if spans else [])))
            kinds = [*(pa.int64(),) * 6, pa.string(), pa.string()] + ([pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))] if spans else [])
            names = [c.split()[0] for c in _SCHEMA.split(", ")] + (["collapsed", "runs"] if spans else [])
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return run


def _runs_of(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all texts of a batch; only the words of surviving segments are named."""
    begins, ends = segments(ids, doc)
    sizes = ends - begins
    moved = np.cumsum(sizes) - sizes
    where = np.repeat(begins - moved, sizes) + np.arange(sizes.sum())
    start, length, period = runs(ids[where], moved, moved + sizes)
    return (where[start] if len(start) else start), length, period


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, int], np.ndarray | None] | None = None, spans: bool = True) -> DataFrame:
    """One row a text of ``docs(doc_id, text)``: the longest run, digests and, with ``spans``, the collapsed text and all runs."""
    schema = _SCHEMA + (", collapsed string, runs array<struct<start: long, length: long, period: long>>" if spans else "")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(common.releasing(_found(rewrite, spans)), schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(common.table(spark, sf_dir, "documents"), planted, spans=False)
