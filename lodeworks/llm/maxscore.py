"""Exact top-k search over integer vectors by MaxScore.

A component becomes ``floor(256 * x)``, a dimension is a term, and a row is in the lists of the terms of which it has a
component, with that as its impact. Rows are packed into shards; a shard's index has a list of row numbers and impacts
for each term, and the greatest and the least impact of each.

What a term can add to a query's score is bounded by its weight times one of the two. Per query and shard the terms are
ordered by these bounds. Those at the end whose bounds together stay under the score of the k-th best row so far are
non-essential: a row that is in none of the other, essential lists can't compete. Essential lists are traversed, for a
block of queries at a time; the rows whose score there, with the bounds still open, reaches the k-th score are probed in
the other lists, the weightiest first, and dropped once they no longer can. A shard whose bounds together stay under the
k-th score is passed over. While fewer than k rows are held, or the k-th score isn't positive, every row competes.

Queries are all rows asked for, in blocks that are sent to every cell of shards (``tiles.meet``); each tile carries a
query's best k from shard to shard, and tiles are merged by taking the best k again.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; vectors of different
lengths never meet; a row is never its own candidate, but a repeated row is, and two equal queries have each their own
results; a candidate without an id comes after all others in ties and is given out as null; an empty table gives no
rows; columns besides ``vec_id`` and ``embedding`` are not read; where scores can pass 2^53, every row of the shard
competes and sums are taken in Python's integers, and a score beyond a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm import common
from lodeworks.llm.negatives import longs, numbered_rows, products
from lodeworks.operators.tiles import Block, blocks, firsts, front, meet

TOP = 5
_QUERIES, _SHARD = 256, 4096


class Shard:
    """Lists of the rows of one block: of each dimension the rows with a component there, and the components."""

    def __init__(self, block: Block):
        self.width = block.width
        self.row, self.key, self.none, self.starts, self.places, self.impacts = block.numbers
        self.most, self.least = (self._extreme(f) for f in (np.maximum, np.minimum))
        self.full = None
        if 8 * len(self.places) > len(self.row) * self.width:  # lists that hold most rows are kept at full length
            self.full = np.zeros((self.width, len(self.row)), np.int64)
            self.full[np.repeat(np.arange(self.width), np.diff(self.starts)), self.places] = self.impacts

    def _extreme(self, f: np.ufunc) -> np.ndarray:
        """The greatest or least impact of each list, 0 being that of rows outside it."""
        out = np.zeros(self.width, np.int64)
        f.at(out, np.repeat(np.arange(self.width), np.diff(self.starts)), self.impacts)
        return out

    @staticmethod
    def arrays(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each list begins, and the lists' row numbers and impacts."""
        dimension, place = np.nonzero(vectors.T)
        return np.searchsorted(dimension, np.arange(vectors.shape[1] + 1)), place, vectors[place, dimension]

    def traverse(self, weights: np.ndarray) -> np.ndarray:
        """Scores of all rows (columns) from the lists in which each query (rows) has a weight."""
        if self.full is not None:
            return products(weights, self.full.T)
        exact = float(np.abs(weights).max(initial=0)) * float(max(self.most.max(initial=0), -self.least.min(initial=0))) * self.width < 2.0**53
        out = np.zeros((len(weights), len(self.row)), np.float64 if exact else object)
        for d in np.flatnonzero(weights.any(axis=0)).tolist():
            span = slice(self.starts[d], self.starts[d + 1])
            asking = np.flatnonzero(weights[:, d])
            out[np.ix_(asking, self.places[span])] += weights[asking, d, None].astype(out.dtype) * self.impacts[span].astype(out.dtype)
        return out if exact else longs(out)

    def probe(self, d: int, rows: np.ndarray) -> np.ndarray:
        """The impacts of some rows in one list, 0 outside it."""
        if self.full is not None:
            return self.full[d, rows]
        places, impacts = self.places[self.starts[d] : self.starts[d + 1]], self.impacts[self.starts[d] : self.starts[d + 1]]
        if not len(places):
            return np.zeros(len(rows), np.int64)
        at = np.minimum(np.searchsorted(places, rows), len(places) - 1)
        return np.where(places[at] == rows, impacts[at], 0)


def competitors(shard: Shard, queries: np.ndarray, floors: np.ndarray, k: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, places and exact scores of the rows of ``shard`` that reach their query's floor; of a query without one, its best ``k``.

    A query has no floor if that isn't positive. ``counts`` gathers list entries in all, entries read, pairs of query and
    shard, and of these the ones passed over.
    """
    high = queries * shard.most
    exact = float(np.abs(queries.astype(np.float64)).max(initial=0)) * float(max(shard.most.max(initial=0), -shard.least.min(initial=0))) * shard.width < 2.0**53
    sizes = np.diff(shard.starts)
    everyone = (floors <= 0) if exact else np.ones(len(queries), bool)
    bound = np.maximum(np.maximum(high, queries * shard.least), 0) if exact else np.zeros(queries.shape, np.int64)
    by_bound = np.argsort(-bound, axis=1, kind="stable")
    left = np.zeros((len(queries), shard.width + 1), np.int64)  # what the terms from here on can add
    left[:, :-1] = np.cumsum(np.take_along_axis(bound, by_bound, axis=1)[:, ::-1], axis=1)[:, ::-1]
    essential = np.where(everyone, shard.width, (left >= floors[:, None]).sum(axis=1))
    rank = np.empty_like(by_bound)
    np.put_along_axis(rank, by_bound, np.arange(shard.width)[None, :], axis=1)
    asked = np.flatnonzero(essential > 0)
    score = shard.traverse(np.where(rank < essential[:, None], queries, 0)[asked])
    if counts is not None:
        counts += [int((sizes * (queries != 0)).sum()), int((sizes * ((rank < essential[:, None]) & (queries != 0))).sum()), len(queries), len(queries) - len(asked)]
    out = []
    free = np.flatnonzero(everyone[asked])
    if len(free):
        i, j = firsts(score[free], k)
        out.append((asked[free][i], j, score[free[i], j].astype(np.int64)))
    for at in np.flatnonzero(~everyone[asked]).tolist():
        q = int(asked[at])
        open_bound, floor = int(left[q, essential[q]]), int(floors[q])
        now = np.flatnonzero(score[at] + open_bound >= floor)
        own = score[at, now].astype(np.int64)
        for t in range(int(essential[q]), shard.width):
            if not len(now):
                break
            d = by_bound[q, t]
            if queries[q, d]:
                own = own + queries[q, d] * shard.probe(d, now)
                if counts is not None:
                    counts[1] += len(now)
                reach = own + int(left[q, t + 1]) >= floor
                now, own = now[reach], own[reach]
        if len(now):
            out.append((np.full(len(now), q), now, own))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of vectors as blocks of posting lists."""
    for rows in batches:
        for i in range(rows.num_rows):
            one = rows.slice(i, 1)
            vectors = np.frombuffer(one.column("vectors")[0].as_py(), np.int64).reshape(-1, one.column("width")[0].as_py())
            numbers = one.column("numbers")[0].as_py() + [a.astype(np.int64).tobytes() for a in Shard.arrays(vectors)]
            yield pa.RecordBatch.from_arrays([*one.select(["part", "block", "width"]).columns, pa.array([b""], pa.binary()), pa.array([numbers], pa.list_(pa.binary())), one.column("texts")], ["part", "block", "width", "vectors", "numbers", "texts"])


def _search(k: int):
    def run(held: list[Block], others: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        best = [[np.zeros(0, np.int64)] * 5 for _ in held]  # by block: query, score, key, row, none
        for other in others:
            shard = Shard(other)
            for b, block in enumerate(held):
                if block.width != shard.width:
                    continue
                floors = np.zeros(len(block.vectors), np.int64)
                q, score = best[b][:2]
                held_rows = np.bincount(q, minlength=len(floors))
                full = held_rows >= k
                floors[full] = score[(np.cumsum(held_rows) - 1)[full]]  # in order of query, the best first
                i, at, value = competitors(shard, block.vectors, floors, k + 1)  # a query may find itself
                apart = shard.row[at] != block.numbers[0][i]
                i, at, value = i[apart], at[apart], value[apart]
                new = [np.concatenate(c) for c in zip(best[b], (i, value, shard.key[at], shard.row[at], shard.none[at]), strict=True)]
                first = front([new[0]], [-new[1], new[2], new[3]], k)
                best[b] = [c[first] for c in new]
        for (q, score, key, row, none), block in zip(best, held, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (block.numbers[0][q], score, key, row, none)], ["asker", "score", "key", "row", "none"])

    return run


def index(rows: DataFrame) -> DataFrame:
    """Shards of posting lists over ``row, key, none, v``, settled."""
    return common.settle(blocks(rows, "v", ["row", "key", "none"], size=_SHARD, kind="<i8", name="maxscore-rows").mapInArrow(_index, "part int, block int, width int, vectors binary, numbers array<binary>, texts array<array<string>>"), "maxscore-index")


def exact_top(vectors: DataFrame, k: int = TOP, asked: Column | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of each row that ``asked`` holds for (by default every 50th id)."""
    asked = F.coalesce(F.col("vec_id") % 50 == 0 if asked is None else asked, F.lit(False)) & F.col("vec_id").isNotNull()
    rows = numbered_rows(vectors, {"asked": asked}, "maxscore-vectors")
    queries = blocks(rows.where("asked"), "v", ["row"], size=_QUERIES, kind="<i8", name="maxscore-queries")
    found = meet(queries, index(rows), _search(k), "asker long, score long, key long, row long, none long", ("<i8", "<i8"))
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "key", "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = rows.where("asked").select(F.col("row").alias("asker"), F.col("key").alias("query_id"))
    return best.join(ids, "asker").select("query_id", "rank", F.when(F.col("none") == 0, F.col("key")).alias("vec_id"), "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top(common.table(spark, sf_dir, "embeddings"))


OP11_SQL = """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, c.r, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) AS k FROM s) WHERE k <= 5"""
