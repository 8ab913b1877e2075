"""Approximate nearest neighbours by cosine: inverted lists of product-quantised residuals, with exact re-ranking.

Centres and code books are fitted on a bounded sample; every row is indexed: it goes to the list of its nearest centre,
as one byte for each part of what is left of it. A query reads the lists of its ``probes`` nearest centres, scores their
codes from a table of products, and the ``depth`` best are scored again from the stored vectors.

A list lies in blocks of bounded size, and blocks in cells; queries are sent to the cells of their lists, so a list that
holds most rows is many cells and no task gets it whole. Only centres and code books, whose size the parameters fix, are
sent to every task.

Defined cases: vectors that are null, empty, of another width than the first of the sample, zero, or hold a null or
non-finite component are neither indexed nor asked; repeated ids are rows of their own in the index and one hit in the
result (their best); equal scores go to the lower id; an empty corpus gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.session import settle

_BLOCK, _CELL, _PACK = 2048, 8, 256


@dataclass(frozen=True)
class Codebook:
    """``centres[list, d]`` and ``books[part, code, d / parts]``, for vectors of length one."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def split(self, x: np.ndarray) -> np.ndarray:
        """Rows cut into parts, the last one filled with zeros."""
        parts, _, w = self.books.shape
        return np.pad(x, ((0, 0), (0, parts * w - x.shape[1]))).reshape(len(x), parts, w)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and the codes of each row."""
        own = np.argmax(x @ self.centres.T - (self.centres**2).sum(axis=1) / 2, axis=1)
        rest = self.split(x - self.centres[own])
        codes = [np.argmax(rest[:, p] @ b.T - (b**2).sum(axis=1) / 2, axis=1) for p, b in enumerate(self.books)]
        return own, np.stack(codes, axis=1).astype(np.uint8)

    def scores(self, queries: np.ndarray, number: int, codes: np.ndarray) -> np.ndarray:
        """Products of queries (rows) with the coded rows of one list (columns), by a table for each query and part."""
        table = np.einsum("qpw,pcw->qpc", self.split(queries), self.books)
        out = np.repeat((queries @ self.centres[number])[:, None], len(codes), axis=1)
        for p in range(codes.shape[1]):
            out += table[:, p, codes[:, p]]
        return out


def _means(x: np.ndarray, k: int, steps: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        own = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: Column, width: int | None = None) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(good & (F.size(vector) == width if width else F.size(vector) > 0), F.lit(False))


def train(corpus: DataFrame, id_col: str = "id", vector_col: str = "embedding", lists: int = 32, parts: int = 16, codes: int = 64, sample: int = 8192, steps: int = 12, seed: int = 0) -> Codebook | None:
    """Fit on the ``sample`` rows of the lowest hashes; None without a usable row. ``codes`` is 256 at most."""
    some = corpus.where(usable(F.col(vector_col))).select(F.col(vector_col).cast("array<double>").alias("v")).orderBy(F.xxhash64(id_col), id_col).limit(sample).toArrow().column(0).to_pylist()
    if not some:
        return None
    x = _unit(np.array([v for v in some if len(v) == len(some[0])], float))
    rng = np.random.default_rng(seed)
    centres = _means(x, lists, steps, rng)
    own = np.argmax(x @ centres.T - (centres**2).sum(axis=1) / 2, axis=1)
    w = -(-x.shape[1] // parts)
    rest = np.pad(x - centres[own], ((0, 0), (0, parts * w - x.shape[1]))).reshape(len(x), parts, w)
    books = [_means(rest[:, p], min(codes, 256), steps, rng) for p in range(parts)]
    return Codebook(centres, np.stack(books))


def _encoded(book: Codebook):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if rows.num_rows:
                own, codes = book.encode(_unit(np.array(rows.column(1).to_pylist(), float)))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "list", "code"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``list, id, code`` in order of list as blocks of one list."""
    held: list[tuple] = []

    def close() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([held[0][0]], pa.int32()), pa.array([held[0][1]], pa.int64()), pa.array([np.array([h[1] for h in held], np.int64).tobytes()], pa.binary()), pa.array([b"".join(h[2] for h in held)], pa.binary())],
            ["list", "first", "ids", "codes"],
        )
        held.clear()
        return out

    for rows in batches:
        for item in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if held and (held[0][0] != item[0] or len(held) >= _BLOCK):
                yield close()
            held.append(item)
    if held:
        yield close()


def build(corpus: DataFrame, book: Codebook, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The index, ``list, cell, ids, codes``, settled: every usable row of the corpus in one block of its list."""
    rows = corpus.where(usable(F.col(vector_col), book.width) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    coded = settle(rows.mapInArrow(_encoded(book), "id long, list int, code binary"), "ann-codes")
    # ranges of list and id: a long list lies in several partitions
    packed = settle(coded.select("list", "id", "code").repartitionByRange("list", "id").sortWithinPartitions("list", "id").mapInArrow(_blocks, "list int, first long, ids binary, codes binary"), "ann-blocks")
    number = F.row_number().over(Window.partitionBy("list").orderBy("first")) - 1  # over one row a block, without its codes
    cells = packed.select("list", "first", F.floor(number / _CELL).cast("int").alias("cell")).distinct()
    return settle(packed.join(cells, ["list", "first"]).select("list", "cell", "ids", "codes"), "ann-index")


def _probed(book: Codebook, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, np.ndarray]]] = {}

        def pack(number: int) -> pa.RecordBatch:
            own = held.pop(number)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.array([q for q, _ in own], np.int64).tobytes()], pa.binary()), pa.array([np.array([v for _, v in own]).tobytes()], pa.binary())], ["list", "qids", "vectors"])

        for rows in batches:
            if not rows.num_rows:
                continue
            x = _unit(np.array(rows.column(1).to_pylist(), float))
            near = np.argsort(-(x @ book.centres.T - (book.centres**2).sum(axis=1) / 2), axis=1)[:, :probes]
            for qid, v, numbers in zip(rows.column(0).to_pylist(), x, near.tolist(), strict=True):
                for number in numbers:
                    held.setdefault(number, []).append((qid, v))
                    if len(held[number]) >= _PACK:
                        yield pack(number)
        for number in list(held):
            yield pack(number)

    return run


def search(queries: DataFrame, corpus: DataFrame, index: DataFrame, book: Codebook, k: int = 10, probes: int = 16, depth: int = 200, id_col: str = "id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """``qid, rank, id, score`` of every usable row of ``queries``; the scores are those of the stored vectors."""
    asked = queries.where(usable(F.col(vector_col), book.width) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("qid"), F.col(vector_col).cast("array<double>").alias("v"))
    cells = index.select("list", "cell").distinct()
    packs = asked.mapInArrow(_probed(book, probes), "list int, qids binary, vectors binary").join(cells, "list")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                r = {n: c[i].as_py() for n, c in zip(rows.schema.names, rows.columns, strict=True)}
                qids, ids = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64)
                s = book.scores(np.frombuffer(r["vectors"]).reshape(len(qids), -1), r["list"], np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1))
                n = min(depth, len(ids))
                at = np.argpartition(-s, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, n)), pa.array(ids[at].ravel()), pa.array(np.take_along_axis(s, at, axis=1).ravel())], ["qid", "id", "near"])

    found = packs.join(index, ["list", "cell"]).select("list", "qids", "vectors", "ids", "codes").mapInArrow(best, "qid long, id long, near double")
    once = found.groupBy("qid", "id").agg(F.max("near").alias("near"))
    chosen = once.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("near"), "id"))).where(F.col("place") <= depth).select("qid", "id")
    stored = corpus.where(usable(F.col(vector_col), book.width)).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    exact = F.round(dot("v", "e") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("e", "e"))), digits)
    scored = chosen.join(stored, "id").join(asked, "qid").select("qid", "id", exact.alias("score")).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``qid, n, hits, recall``: the share of the exact neighbours that were found."""
    hit = found.select("qid", "id", F.lit(1).alias("hit"))
    return exact.join(hit, ["qid", "id"], "left").groupBy("qid").agg(F.count("*").alias("n"), F.count("hit").alias("hits")).withColumn("recall", F.round(F.col("hits") / F.col("n"), 6))
