"""MinHash near-duplicates with tensored banding, confirmed on whole shingle sets.

Two small collections of sub-signatures, 12 and 12 of two minhashes each, are computed per document: 48 minhashes. Every
pair of one from each collection is a table key, so 144 tables of four rows come from 48 instead of 576 minhashes. At
a similarity of 0.75 a pair meets in no table with a chance of ``1 - (1 - (1 - 0.75^2)^12)^2``, one in ten thousand.

Texts with equal shingle sets are one node from the start. Nodes that meet in a table and whose 48 one-byte sketches
agree well enough become candidates; the components of the candidate graph are the groups in which links are decided.
A group's sets are compared exactly, in tiles of bounded size. A group of more than one block is first compared with
its first block, which joins most of it, and then only tiles that can still join different components are compared.
A table's bucket of more rows than one task should compare goes the same way with its sketches, so that every bucket is
compared whole and by the same rule. No group lies in one task; a bucket's keys do: they pass through one task in pieces
of bounded memory, whose time grows with the largest bucket.

Defined cases: a null text or one without words has an empty set and links with nothing (its component is itself);
fewer than five words are one shingle; only A to Z are lower-cased; rows without a ``doc_id`` take part but never name a
component unless all its rows lack one; repeated rows are copies; an empty table gives no rows; columns besides
``doc_id`` and ``text`` are not read. Shingles are compared by 64-bit hashes and whole sets by 128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm import common
from lodeworks.llm.graph import Stars, components, forest_edges, place_bits

SHINGLE = 5
COLLECTION, ROWS = 12, 2  # two collections of 12 sub-signatures of 2 minhashes
HASHES = 2 * COLLECTION * ROWS
#: A pair goes on if so many of the 48 one-byte sketches agree; at 0.75 one in a hundred thousand has fewer.
LEAST_AGREE = 22
#: Rows of a bucket that are compared in place; longer buckets are compared in blocks of half as many.
BUCKET = 2048
_BLOCK = 60_000  # shingles in a block of a group, counting 200 for smaller sets
#: Bits a grouped row in the bitmap that spares other texts the second reading, and the most it may have (32 MB).
_BITS_A_ROW, _MOST_BITS = 16, 28
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_rng = np.random.default_rng(20240607)
_MULTIPLIERS = _rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE_SALT = _rng.integers(1, 1 << 63, COLLECTION * COLLECTION, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """Hashes of words, forgotten when too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word, 7)
        if len(word) <= 64:
            self[word] = h
        return h


_words = _Words()


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode().translate(_TABLE).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    x = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(x)


def set_keys(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return int.from_bytes((d >> 64).to_bytes(8, "little"), "little", signed=True), int.from_bytes((d & (1 << 64) - 1).to_bytes(8, "little"), "little", signed=True)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """48 minhashes of each non-empty set, as unsigned 32-bit numbers."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat * _MULTIPLIERS[k]) >> np.uint64(32), starts).astype(np.uint32)
    return out


def table_keys(sig: np.ndarray) -> np.ndarray:
    """The 144 table keys of each signature: every pair of one sub-signature from each collection."""
    sub = sig.astype(np.uint64).reshape(len(sig), 2, COLLECTION, ROWS)
    sub = _mix(sub[..., 0] << np.uint64(32) | sub[..., 1])
    pairs = sub[:, 0, :, None] + (sub[:, 1, None, :] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(3)
    return _mix(pairs.reshape(len(sig), -1) ^ _TABLE_SALT)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in common.documents_in_pieces(batches, 1):
        sets = [shingle_set(t) for t in texts]
        keys = [set_keys(s) for s in sets]
        full = [i for i, s in enumerate(sets) if len(s)]
        sig: list[bytes | None] = [None] * len(sets)
        if full:
            for i, row in zip(full, signatures([sets[i] for i in full]), strict=True):
                sig[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sig, pa.binary())],
            ["doc_id", "h", "n", "k1", "k2", "sig"],
        )
    _words.clear()


@common.releasing
def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for at in range(0, rows.num_rows, 2000):
            piece = rows.slice(at, 2000)
            sig = np.frombuffer(b"".join(piece.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            keys = table_keys(sig)
            nodes = np.repeat(piece.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(nodes)], ["key", "node"])


def _sketches(sig: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(HASHES), len(sig), [None, pa.py_buffer(np.ascontiguousarray(sig.astype(np.uint8)))]).cast(pa.binary())


def _heads(tables: tuple[int, ...]):
    """The rows of a few tables with their sketches; each node is its own root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, 2000):
                piece = rows.slice(at, 2000)
                sig = np.frombuffer(b"".join(piece.column(2).to_pylist()), np.uint32).reshape(-1, HASHES)
                keys = table_keys(sig)[:, list(tables)]
                each = np.repeat(np.arange(len(sig)), len(tables))
                node = piece.column(0).take(pa.array(each))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), node, piece.column(1).take(pa.array(each)), _sketches(sig).take(pa.array(each)), node], ["key", "node", "n", "data", "root"])

    return run


def _runs(tables: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows cut so that no key goes on in the next; a key with very many rows makes a long batch."""
    held: list[pa.RecordBatch] = []
    for rows in tables:
        if not rows.num_rows:
            continue
        keys = rows.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if held and (cut > 0 or held[-1].column(key)[-1].as_py() != int(keys[0])):
            if held[-1].column(key)[-1].as_py() == int(keys[0]):
                first = int(np.searchsorted(keys, keys[0], "right"))
                held.append(rows.slice(0, first))
                rows = rows.slice(first)
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
            if not rows.num_rows:
                continue
            keys = rows.column(key).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
        if not held and cut:
            yield rows.slice(0, cut)
            rows = rows.slice(cut)
        held.append(rows)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@common.releasing
def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that more than one row has; one row is held between batches."""
    last: tuple[int, int] | None = None
    sent = False
    for rows in batches:
        keys, nodes = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        if not len(keys):
            continue
        if last is not None:
            keys, nodes = np.concatenate([[last[0]], keys]), np.concatenate([[last[1]], nodes])
        same = keys[1:] == keys[:-1]
        member = np.zeros(len(keys), bool)
        member[1:] |= same
        member[:-1] |= same
        if last is not None and sent:
            member[0] = False  # it went out with the batch before
        sent = bool(member[-1]) or (sent and len(keys) == 1)
        last = int(keys[-1]), int(nodes[-1])
        if member.any():
            yield pa.RecordBatch.from_arrays([pa.array(keys[member]), pa.array(nodes[member])], ["key", "node"])


def _agreeing(sketch: np.ndarray, sizes: np.ndarray, some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` agree well enough with one of ``some``."""
    hit = np.zeros(len(others), bool)
    step = max(1, 400_000 // len(others))
    for s in range(0, len(some), step):
        todo = np.flatnonzero(~hit)
        if not len(todo):
            break
        x, y = some[s : s + step], others[todo]
        if len(x) * len(y) <= 4000:
            agree = (sketch[x][:, None, :] == sketch[y][None, :, :]).sum(axis=2)
        else:
            agree = np.zeros((len(x), len(y)), np.uint8)
            for k in range(HASHES):
                agree += sketch[x, k][:, None] == sketch[y, k]
        n, m = sizes[x][:, None], sizes[y]
        hit[todo[((agree >= LEAST_AGREE) & (4 * np.minimum(n, m) >= 3 * np.maximum(n, m))).any(axis=0)]] = True
    return hit


def grown(n: int, joined) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges (member, root) of the components of ``n`` items; ``joined(some, others)`` tells which others one of some links with.

    Each component grows from its first item, so that what is found is not compared again.
    """
    left = np.arange(n)
    members, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            hit = joined(front, left)
            front, left = left[hit], left[~hit]
            members.append(front)
            roots.append(np.full(len(front), root))
    return np.concatenate(members), np.concatenate(roots)


def sketch_forest(sketch: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return grown(len(sizes), lambda some, others: _agreeing(sketch, sizes, some, others))


def _bucket_edges(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ends of a forest, per bucket of whole buckets, of the pairs whose sketches agree, as far as it joins different roots."""
    keys, sizes, roots = (rows.column(k).to_numpy() for k in (0, 2, 4))
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(keys)]]))
    mixed = np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)
    starts, counts = starts[mixed], counts[mixed]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(starts):
        sketch = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(-1, HASHES)
        two = starts[counts == 2]
        ok = (sketch[two] == sketch[two + 1]).sum(axis=1) >= LEAST_AGREE
        ok &= 4 * np.minimum(sizes[two], sizes[two + 1]) >= 3 * np.maximum(sizes[two], sizes[two + 1])
        a.append(two[ok])
        b.append(two[ok] + 1)
        for s, c in zip(starts[counts > 2].tolist(), counts[counts > 2].tolist(), strict=True):
            x, y = sketch_forest(sketch[s : s + c], sizes[s : s + c])
            a.append(s + x)
            b.append(s + y)
    x, y = np.concatenate(a), np.concatenate(b)
    new = roots[x] != roots[y]
    return x[new], y[new]


def _pieces(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[pa.RecordBatch, bool, bool]]:
    """Whole buckets together, or a piece of about ``longest`` rows of one longer bucket, with whether it is one and whether it is its first."""
    held: list[pa.RecordBatch] = []
    size, running = 0, None

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        for at in range(0, batch.num_rows, longest):
            rows = batch.slice(at, longest)
            held.append(rows)
            size += rows.num_rows
            if size <= longest:
                continue
            whole = joined()
            keys = whole.column(0).to_numpy()
            running = running if running == int(keys[0]) else None
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                ended = 0 if running is None else int(np.searchsorted(keys, keys[0], "right"))
                if ended:
                    yield whole.slice(0, ended), True, False
                if cut > ended:
                    yield whole.slice(ended, cut - ended), False, True
                whole, running = whole.slice(cut), None
            if whole.num_rows > longest or running is not None:
                yield whole, True, running is None
                running, held, size = int(keys[-1]), [], 0
            else:
                held, size = [whole], whole.num_rows
    if held:
        whole = joined()
        keys = whole.column(0).to_numpy()
        ended = int(np.searchsorted(keys, keys[0], "right")) if running == int(keys[0]) else 0
        if ended:
            yield whole.slice(0, ended), True, False
        if whole.num_rows > ended:
            yield whole.slice(ended), False, True


@common.releasing
def _early_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of whole buckets; of a longer one, each piece is compared with itself and with the bucket's first rows."""
    first: pa.RecordBatch | None = None
    for rows, long_, begins in _pieces(batches, BUCKET):
        if long_:
            if begins:
                first = rows.slice(0, BUCKET // 8)
            else:
                rows = pa.Table.from_batches([first, rows]).combine_chunks().to_batches()[0]
        x, y = _bucket_edges(rows)
        nodes = rows.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], ["a", "b"])


@common.releasing
def _candidate_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges ``a, b`` of whole buckets, reduced to a forest; the rows of longer buckets go on as ``a`` (node), ``b`` (root) and ``key``."""
    forest_ = Stars()

    def reduced() -> pa.RecordBatch:
        rows = forest_.take()
        return rows.append_column("key", pa.nulls(rows.num_rows, pa.int64()))

    for rows, long_, _ in _pieces(batches, BUCKET):
        if long_:
            yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(4), rows.column(0)], ["a", "b", "key"])
            continue
        x, y = _bucket_edges(rows)
        nodes = rows.column(1).to_numpy()
        forest_.add(nodes[x], nodes[y])
        if forest_.full:
            yield reduced()
    if forest_.size:
        yield reduced()


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges (member, root) of the components of a symmetric boolean matrix."""
    left = np.ones(len(near), bool)
    members, roots = [], []
    for root in range(len(near)):
        if not left[root]:
            continue
        left[root] = False
        frontier = np.array([root])
        while len(frontier):
            frontier = np.flatnonzero(near[frontier].any(axis=0) & left)
            left[frontier] = False
            members.append(frontier)
            roots.append(np.full(len(frontier), root))
    return (np.concatenate(members), np.concatenate(roots)) if members else (np.zeros(0, int), np.zeros(0, int))


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sorted sets have ``100 * intersection >= 75 * union``, exactly."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    common_ = np.zeros((n, n), np.int32)
    flat, rows = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    column = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])])
    repeated = np.bincount(column)[column] > 1
    column, rows = column[repeated], rows[repeated]
    if len(column):
        column = np.concatenate([[0], np.cumsum(column[1:] != column[:-1])])
        width = 1024
        cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
        for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            dense = np.zeros((n, width), np.float32)
            dense[rows[s:e], column[s:e] - k * width] = 1
            common_ += (dense @ dense.T).astype(np.int32)  # whole numbers up to 1024, exact in any float
    near = 100 * common_.astype(np.int64) >= 75 * (sizes[:, None] + sizes[None, :] - common_)
    np.fill_diagonal(near, False)
    return near


def set_forest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tree edges of the exact links among sorted sets.

    Components are grown one set at a time as long as that takes most of what is left; a remainder of unlike sets is
    compared by matrix products.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = np.argsort(-sizes, kind="stable") if len(sets) > 2 else np.arange(len(sets))

    def against(one: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` link with one set."""
        fits = 4 * np.minimum(sizes[others], sizes[one]) >= 3 * np.maximum(sizes[others], sizes[one])
        out = np.zeros(len(others), bool)
        if fits.any():
            own = others[fits]
            flat = np.concatenate([sets[i] for i in own.tolist()])
            at = np.searchsorted(sets[one], flat)
            same = sets[one][np.minimum(at, sizes[one] - 1)] == flat
            shared = np.add.reduceat(same.astype(np.int64), np.concatenate([[0], np.cumsum(sizes[own])[:-1]]))
            out[fits] = 100 * shared >= 75 * (sizes[own] + sizes[one] - shared)
        return out

    def joined(some: np.ndarray, others: np.ndarray) -> np.ndarray:
        if len(some) <= len(others):
            hit = np.zeros(len(others), bool)
            for i in some.tolist():
                todo = np.flatnonzero(~hit)
                if not len(todo):
                    break
                hit[todo[against(i, others[todo])]] = True
            return hit
        return np.array([against(i, some).any() for i in others.tolist()], bool)

    poor = 0
    while len(left) > 1 and (poor < 4 or len(left) <= 8):
        before, root, left = len(left), int(left[0]), left[1:]
        front = np.array([root])
        while len(front) and len(left):
            if min(len(front), len(left)) > 32:
                break
            hit = joined(front, left)
            front, left = left[hit], left[~hit]
            x.append(front)
            y.append(np.full(len(front), root))
        if len(front) and len(left):  # a wide front and much left: all of both at once
            both = np.concatenate([front, left])
            m, r = forest(similar([sets[i] for i in both.tolist()]))
            x.append(both[m])
            y.append(both[r])
            return np.concatenate(x), np.concatenate(y)
        poor += 2 * len(left) > before
    if len(left) > 1:
        m, r = forest(similar([sets[i] for i in left.tolist()]))
        x.append(left[m])
        y.append(left[r])
    return np.concatenate(x), np.concatenate(y)


def _in_tiles(joined):
    """Forest of links in each tile of sorted ``tile, node, n, data`` rows; ``joined(sizes, data)`` links the rows of one tile."""

    @common.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            tiles, nodes, sizes = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], tiles[1:] != tiles[:-1]])).tolist()
            a, b = [], []
            for s, e in zip(starts, [*starts[1:], len(tiles)], strict=True):
                own, first = np.unique(nodes[s:e], return_index=True)
                if len(own) > 1:
                    x, y = joined(sizes[s:e][first], [rows.column(3)[s + i].as_py() for i in first.tolist()])
                    a.append(own[x])
                    b.append(own[y])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


_by_sets = _in_tiles(lambda sizes, data: set_forest([np.frombuffer(d, np.uint64) for d in data]))
_by_sketches = _in_tiles(lambda sizes, data: sketch_forest(np.frombuffer(b"".join(data), np.uint8).reshape(-1, HASHES), sizes))


@lru_cache(maxsize=1)
def _bitmap(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        return np.frombuffer(f.read(), np.uint64)


def _sets(bitmap: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _bitmap(SparkFiles.get(bitmap))

        def grouped(rows: pa.RecordBatch) -> pa.RecordBatch:
            place = rows.column(0).to_numpy()
            hit = (bits[place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1)
            return rows.filter(pa.array(hit.astype(bool)))

        for kept, texts in common.documents_in_pieces(map(grouped, batches), 1):
            sets = list(map(shingle_set, texts))
            keys = [set_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), kept.column(2)], ["k1", "k2", "data", "lead_id"]
            )
        _words.clear()

    return run


def _in_order(placed: DataFrame, joined, name: str) -> DataFrame:
    """Links within the tiles of ``placed(tile, node, n, data)``; a tile has at most about two blocks."""
    return forest_edges(placed.select("tile", "node", "n", "data").repartition("tile").sortWithinPartitions("tile"), name, joined)


def _first_links(sets: DataFrame, weight: Column, block: int, joined) -> tuple[DataFrame, DataFrame]:
    """Links found by comparing every block of a group with the group's block 0, and the groups of several blocks.

    A group is cut into blocks of ``block`` weight; a group of one block is compared whole.
    """
    groups = sets.groupBy("grp").agg(F.ceil(F.sum(weight) / block).cast("int").alias("blocks"))
    large = common.settle(groups.where("blocks > 1"), "near-large")
    blocks = F.coalesce("blocks", F.lit(1))
    at = F.pmod(F.xxhash64("node", F.lit(1)), blocks).cast("int")
    to = F.when(at == 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(at))
    placed = sets.join(large, "grp", "left").select("grp", "node", "n", "data", F.explode(to).alias("j"))
    return _in_order(placed.withColumn("tile", F.xxhash64("grp", "j", F.lit(0))), joined, "near-links"), large


def _last_links(items: DataFrame, rooted: DataFrame, weight: Column, block: int, joined) -> DataFrame | None:
    """Links between what is not in the largest component of its group and all of the group; none if no group has a rest.

    ``rooted(grp, node, n, root)`` are the items to compare and their components so far. With ``_first_links`` this
    compares every pair that could still join two components.
    """
    sums = rooted.groupBy("grp", "root").agg(F.count("*").alias("c"))
    main = sums.groupBy("grp").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    sided = common.settle(rooted.join(main, "grp").withColumn("rest", F.col("root") != F.col("main")), "near-sided")
    if sided.isEmpty():
        return None
    counts = sided.groupBy("grp", "rest").agg(F.ceil(F.sum(weight) / block).cast("int").alias("k"))
    per = counts.groupBy("grp").agg(F.max(F.when(F.col("rest"), F.col("k"))).alias("rests"), F.max(F.when(~F.col("rest"), F.col("k"))).alias("mains"))
    spread = sided.join(per, "grp").withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    # tiles (r, m) of the rest's blocks and the main blocks, and (r, r') within the rest
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda m: F.xxhash64("grp", F.lit(1), "own", m))
    within = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: F.xxhash64("grp", F.lit(2), F.least("own", r), F.greatest("own", r)))
    as_main = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: F.xxhash64("grp", F.lit(1), r, "own"))
    among = items.select("grp", "node", "n", "data").join(spread.drop("n"), ["grp", "node"])
    placed = among.select("node", "n", "data", F.explode(F.when(F.col("rest"), F.concat(with_main, within)).otherwise(as_main)).alias("tile"))
    return _in_order(placed, joined, "near-links")


def _set_links(sets: DataFrame) -> DataFrame:
    """Exact links of ``sets(grp, node, n, data)`` within their groups, enough of them to join what is linked."""
    weight = F.greatest("n", F.lit(200))
    found, large = _first_links(sets, weight, _BLOCK, _by_sets)
    if large.isEmpty():
        return found
    # what is not yet in a group's main component, against all of the group
    within = sets.select("grp", "node", "n").join(large, "grp", "left_semi")
    rooted = within.join(components(found, reduced=True), "node", "left").select("grp", "node", "n", F.coalesce("root", "node").alias("root"))
    more = _last_links(sets, common.settle(rooted, "near-rooted"), weight, _BLOCK, _by_sets)
    return found if more is None else found.unionByName(more)


_ROW = "key long, node long, n long, data binary, root long"


def _groups(nodes: DataFrame) -> DataFrame:
    """``node, root`` of the candidate groups of ``nodes(node, n, sig)``.

    A first pass over the twelve tables of equal places joins nearly all copies. The second takes all tables and decides:
    buckets whose rows are joined already are passed over, so a large group does not cost its edges once a table;
    others are compared whole, long ones in tiles.
    """
    some = tuple(range(0, COLLECTION * COLLECTION, COLLECTION + 1))
    heads = nodes.select("node", "n", "sig").mapInArrow(_heads(some), _ROW).repartition("key").sortWithinPartitions("key")
    found = forest_edges(heads, "near-early", _early_edges)
    roots = components(found, reduced=True)
    # one byte of each minhash: the lowest of its little-endian four
    sketches = nodes.join(roots, "node", "left").select("node", "n", "sig", F.coalesce("root", "node").alias("root")).mapInArrow(_sketch, "node long, n long, data binary, root long")
    bands = nodes.select("node", "sig").mapInArrow(_bands, "key long, node long")
    shared = bands.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, node long")
    buckets = shared.join(sketches, "node").select("key", "node", "n", "data", "root").repartition("key").sortWithinPartitions("key")
    told = common.settle(buckets.mapInArrow(_candidate_edges, "a long, b long, key long"), "near-candidates")
    found = found.unionByName(told.where("key is null").select("a", "b"))
    long_ = told.where("key is not null").select(F.col("key").alias("grp"), F.col("a").alias("node"), F.col("b").alias("root"))
    if not long_.isEmpty():
        rows = common.settle(long_.join(sketches.drop("root"), "node"), "near-buckets")
        last = _last_links(rows, rows.drop("data"), F.lit(1), BUCKET // 2, _by_sketches)
        found = found if last is None else found.unionByName(last)
    return components(found, reduced=True)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept, keeper, h`` (a hash of the text).

    ``kept`` marks rows whose ``doc_id`` names their component; ``keeper`` exactly one row of each component. A bitmap of
    the grouped documents, of at most 32 MB, spares most other texts the second reading; it never drops one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    rows = common.settle(docs.withColumn("h", F.xxhash64("text")).mapInArrow(_features, "doc_id long, h long, n long, k1 long, k2 long, sig binary").withColumn("row", F.monotonically_increasing_id()), "near-features")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = common.settle(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("node"), first.alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig")), "near-nodes")
    grouped = common.settle(_groups(nodes).join(nodes.select("node", "k1", "k2", "n", "first"), "node").select(F.col("root").alias("grp"), "node", "k1", "k2", "n", F.col("first.doc_id").alias("doc_id")), "near-grouped")
    bits = min(_MOST_BITS, max(10, (_BITS_A_ROW * grouped.count()).bit_length()))
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << bits) - 1))
    bitmap = common.ship_bytes(spark, "near-filter.bin", place_bits(grouped.select(place.alias("place")), bits))
    again = docs.select(place.alias("place"), "text", F.col("doc_id").alias("lead_id")).mapInArrow(_sets(bitmap), "k1 long, k2 long, data binary, lead_id long")
    # of equal sets only those of the lead's id come along, and of those one
    placed = again.join(grouped, ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("lead_id")))
    sets = common.settle(placed.groupBy("k1", "k2", "grp", "node", "n").agg(F.first("data").alias("data")).select("grp", "node", "n", "data"), "near-sets")
    roots = components(_set_links(sets), reduced=True)
    labelled = common.settle(nodes.select("k1", "k2", "node", "first").join(roots, "node", "left").select("k1", "k2", "first", F.coalesce("root", "node").alias("root")), "near-labels")
    # written first, so that neither side of the join is bound to the grouping and a large component can be split
    named = common.settle(labelled.groupBy("root").agg(F.min("first").alias("lead")), "near-leads")
    by_set = labelled.join(named, "root").select("k1", "k2", F.col("lead.doc_id").alias("lead"), F.col("lead.row").alias("lead_row"))
    joined = rows.select("doc_id", "h", "n", "k1", "k2", "row").join(by_set, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("lead")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.coalesce(F.col("row") == F.col("lead_row"), F.lit(True)).alias("keeper"),
        "h",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` from each group of near-duplicates, and every row that is in no group; columns of any name stay."""
    h, keep_id, keep_h, copy = common.fresh(docs.columns, "h", "keep_id", "keep_h", "copy")
    keep = near_duplicates(docs).where("keeper").select(F.col("doc_id").alias(keep_id), F.col("h").alias(keep_h)).distinct()
    hashed = docs.withColumn(h, F.xxhash64("text"))
    kept = hashed.join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col(keep_id)) & (F.col(h) == F.col(keep_h)), "left_semi")
    # rows equal in id and text count as one, also without words
    once = kept.withColumn(copy, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(F.lit(0)))).where(F.col(copy) == 1)
    return once.select(*docs.columns)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        sig = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint32).reshape(-1, HASHES)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), _sketches(sig), rows.column(3)], ["node", "n", "data", "root"])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("keeper", "h")
