"""Connected components of an edge table; nothing is gathered on the driver, and no task holds more than a bounded part.

Every task first reduces its own edges to a forest. While more than ``one_task`` edges are left, rounds of contraction
bring them down, each by a constant factor at least; what is left then fits in one task by that bound and is finished
there. Both ways are exact, so the bound moves the work only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm import common

#: Edges that one task may hold: 16 bytes each, about ten times that while it works.
ONE_TASK = 2_000_000
_PIECE = 1_000_000


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ends of the edges and, for each, the smallest node that it is joined with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        rx, ry = up[x], up[y]
        apart = rx != ry
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(up, np.maximum(rx, ry), np.minimum(rx, ry))
        while not np.array_equal(higher := up[up], up):
            up = higher
    return nodes, nodes[up]


class Stars:
    """Edges that a task holds, and what is left of them as a forest."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.held.append((a, b))
            self.size += len(a)

    @property
    def full(self) -> bool:
        return self.size >= _PIECE

    def take(self) -> pa.RecordBatch:
        """The edges so far, a star for each component, smallest node first; they are forgotten here."""
        nodes, roots = roots_of(*(np.concatenate(side) for side in zip(*self.held, strict=True)))
        apart = nodes != roots
        self.held, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(roots[apart]), pa.array(nodes[apart])], ["a", "b"])


@common.releasing
def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task, or of each million of them, as a forest."""
    forest = Stars()
    for rows in batches:
        forest.add(rows.column(0).to_numpy(), rows.column(1).to_numpy())
        if forest.full:
            yield forest.take()
    if forest.size:
        yield forest.take()


@common.releasing
def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(rows.column(0).to_numpy(), rows.column(1).to_numpy()) for rows in batches]
    if held:
        nodes, roots = roots_of(*(np.concatenate(side) for side in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def forest_edges(edges: DataFrame, name: str = "component-edges", found=None) -> DataFrame:
    """``edges(a, b)`` reduced within each task, in the shared folder; the same nodes are joined.

    With ``found``, a function of batches that gives edges, ``edges`` are its rows; one worker then does both.
    """
    if found is None:
        return common.settle(edges.select("a", "b").mapInArrow(stars, "a long, b long"), name)
    return common.settle(edges.mapInArrow(lambda batches: stars(found(batches)), "a long, b long"), name)


def components(edges: DataFrame, one_task: int = ONE_TASK, reduced: bool = False) -> DataFrame:
    """``node, root`` for every node of an edge of ``edges(a, b)`` between two nodes; nodes are joined exactly if their roots agree.

    In a round of contraction a node points to the neighbour (or itself) of the lowest priority, a hash that changes
    with the round, and edges are carried over to what their ends point to; a hub costs one row per task. ``reduced``
    edges are those of ``forest_edges`` already.
    """
    e = edges if reduced else forest_edges(edges)
    maps: list[DataFrame] = []
    while (left := e.count()) > one_task:
        seed = F.lit(len(maps))
        both = e.select("a", "b").union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(seed, "b").alias("p"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64(seed, "a").alias("p"), F.col("a").alias("n"))
        step = common.settle(low.select(F.col("a").alias("node"), F.least(F.col("m"), own)["n"].alias("to")), "component-step")
        maps.append(step)
        moved = e.join(step.select(F.col("node").alias("a"), F.col("to").alias("ra")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("rb")), "b")
        e = forest_edges(moved.select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b"))
    last = common.settle(e.coalesce(1).mapInArrow(_finished, "node long, root long"), "components") if left else e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if not maps:
        return last
    labels = maps[0].select("node", F.col("to").alias("root"))
    for step in [*(m.select("node", F.col("to").alias("root")) for m in maps[1:]), last]:
        later = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = labels.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return common.settle(labels, "components")


def place_bits(places: DataFrame, bits: int) -> bytes:
    """A bitmap of ``2 ** bits`` places from ``place long`` rows: merged by word on the executors, ``2 ** bits / 8`` bytes in all."""
    words = places.select((F.col("place") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out.tobytes()
