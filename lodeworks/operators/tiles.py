"""A stated set of vectors against a corpus of vectors, in tiles: neither side is broadcast, gathered or keyed by one value.

Both sides are packed into blocks of one width. Blocks are numbered; a group of left blocks and a cell of right blocks
make a tile. A left block is sent to every cell and a right block to every group, so the work is dealt out by the pair
of the two and a tile's size doesn't depend on the tables. Within a tile the left blocks are held and the right blocks
pass by, one at a time.

Defined cases: null vectors, empty ones and those with a null component are in no block; vectors of different widths are
in different blocks; an empty side gives no tile and no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.session import settle

#: Blocks of either side in a tile.
LEFT, RIGHT = 16, 8


def _pack(numbers: int, texts: int, size: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple]] = {}

        def close(width: int) -> pa.RecordBatch:
            nonlocal block
            columns = list(zip(*held.pop(width), strict=True))
            block += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([block - 1], pa.int32()), pa.array([width], pa.int32()),
                    pa.array([np.array(columns[0], kind).tobytes()], pa.binary()),
                    pa.array([[np.array(c, np.int64).tobytes() for c in columns[1 : 1 + numbers]]], pa.list_(pa.binary())),
                    pa.array([[list(c) for c in columns[1 + numbers :]]], pa.list_(pa.list_(pa.string()))),
                ],
                ["part", "block", "width", "vectors", "numbers", "texts"],
            )

        for rows in batches:
            for at in range(0, rows.num_rows, 1024):
                for item in zip(*(c.slice(at, 1024).to_pylist() for c in rows.columns), strict=True):
                    if item[0] and None not in item[0]:
                        held.setdefault(len(item[0]), []).append(item)
                        if len(held[len(item[0])]) >= size:
                            yield close(len(item[0]))
        for width in list(held):
            yield close(width)

    return run


def blocks(rows: DataFrame, vector: str, numbers: list[str], texts: list[str] | None = None, size: int = 2048, kind: str = "<f8", name: str = "blocks") -> DataFrame:
    """``part, block, width, vectors, numbers, texts``: up to ``size`` vectors of one width to a row, in the order of each task's rows.

    ``numbers`` are columns of longs without nulls, ``texts`` columns of strings. The result is a table in the work folder.
    """
    texts = texts or []
    packed = rows.select(vector, *(F.col(c).cast("long") for c in numbers), *(F.col(c).cast("string") for c in texts))
    return settle(packed.mapInArrow(_pack(len(numbers), len(texts), size, kind), "part int, block int, width int, vectors binary, numbers array<binary>, texts array<array<string>>"), name)


def numbered(packed: DataFrame) -> DataFrame:
    """``packed`` with ``seq``, its blocks counted through; the running sum is over one row for each writing task."""
    parts = packed.groupBy("part").agg(F.count("*").alias("k"))
    begins = parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("begin"))
    return packed.join(begins, "part").withColumn("seq", F.col("begin") + F.col("block")).drop("begin")


class Block:
    """A block's vectors as rows of a matrix, its columns of numbers and its columns of texts."""

    def __init__(self, row: dict, kind: str):
        self.width = row["width"]
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(-1, self.width)
        self.numbers = [np.frombuffer(b, np.int64) for b in row["numbers"]]
        self.texts = row["texts"]


def _counted(n: int) -> Column:
    return F.explode(F.expr(f"sequence(0L, {n - 1}L)"))


def meet(left: DataFrame, right: DataFrame, compare: Callable[[list[Block], Iterator[Block]], Iterator[pa.RecordBatch]], schema: str, kinds: tuple[str, str] = ("<f8", "<f8"), sizes: tuple[int, int] = (LEFT, RIGHT)) -> DataFrame:
    """Rows of ``schema`` that ``compare`` gives for each tile, from its left blocks and an iterator over its right blocks."""
    many, more = left.count(), right.count()
    if not many or not more:
        return left.sparkSession.createDataFrame([], schema)
    wide, high = sizes
    while -(-many // wide) * -(-more // high) < 2 * left.sparkSession.sparkContext.defaultParallelism and (wide, high) != (1, 1):
        wide, high = (wide // 2, high) if wide > 1 else (wide, high // 2)  # small tables: smaller tiles, so that every core has one
    groups, cells = -(-many // wide), -(-more // high)
    payload = ["width", "vectors", "numbers", "texts"]
    l_rows = numbered(left).select(F.floor(F.col("seq") / wide).cast("long").alias("g"), _counted(cells).alias("c"), F.lit(0).alias("side"), "seq", *payload)
    r_rows = numbered(right).select(_counted(groups).alias("g"), F.floor(F.col("seq") / high).cast("long").alias("c"), F.lit(1).alias("side"), "seq", *payload)
    tiles = l_rows.unionByName(r_rows).select((F.col("g") * cells + F.col("c")).alias("tile"), "side", "seq", *payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)} for b in batches for i in range(b.num_rows))
        row = next(rows, None)
        while row is not None:
            tile, held = row["tile"], []
            while row is not None and row["tile"] == tile and row["side"] == 0:
                held.append(Block(row, kinds[0]))
                row = next(rows, None)

            def passing() -> Iterator[Block]:
                nonlocal row
                while row is not None and row["tile"] == tile:
                    yield Block(row, kinds[1])
                    row = next(rows, None)

            others = passing()
            yield from compare(held, others)
            for _ in others:  # what compare left unread
                pass

    dealt = tiles.repartitionByRange(min(groups * cells, 8192), "tile").sortWithinPartitions("tile", "side", "seq")
    return dealt.mapInArrow(run, schema)


def firsts(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` greatest entries of each row, row by row, greatest first, ties to the lower column.

    Entries of minus infinity, or the least integer, are left out.
    """
    none = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
        rows, columns = np.nonzero((scores >= least) & (scores > none))
    else:
        rows, columns = np.nonzero(scores > none)
    order = np.lexsort((columns, -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    within = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
    return rows[within < k], columns[within < k]


def front(groups: list[np.ndarray], order: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the first ``k`` entries of each group, a group being equal values in all of ``groups``, ordered by ``order``."""
    at = np.lexsort([*reversed(order), *reversed(groups)])
    new = np.ones(len(at), bool)
    if len(at):
        new[1:] = np.any([g[at][1:] != g[at][:-1] for g in groups], axis=0)
    begins = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(begins, np.diff([*begins, len(at)]))
    return at[within < k]
