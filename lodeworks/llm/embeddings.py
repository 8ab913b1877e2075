"""Near-duplicate vectors by an epsilon grid order join.

Vectors of equal content are one node. Nodes are sorted by the grid cells (of the width of the search distance) of their
leading principal coordinates, and the sorted sequence is cut into blocks with bounding boxes. Intervals of blocks are
joined recursively: a pair of intervals whose boxes are farther apart than the distance is skipped with all pairs of
its parts; what is left are pairs of blocks, which are compared by a matrix product. Pairs near the threshold are
decided again in double precision from the stored values. Pairs are grouped by bands of eight blocks on either side, so
a block is sent once for each band that it meets.

Principal axes are fitted on at most ``sample`` vectors; any orthonormal axes give the same links, only more slowly.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing (no links,
their own component); vectors of different lengths link with nothing of another length; repeated vectors link with one
another; rows without a ``vec_id`` take part but never name a component unless all its rows lack one; an empty table
gives no rows; columns besides ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm import common
from lodeworks.llm.graph import components
from lodeworks.llm.minhash import forest

_BLOCK = 2048
_FAN = 8
_AXES = 6


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _principal(vectors: np.ndarray) -> np.ndarray:
    """Leading eigenvectors of the second moments, as columns."""
    u = _unit(vectors)
    _, axes = np.linalg.eigh(u.T @ u)
    return axes[:, ::-1][:, :_AXES].copy()


def _place(axes: dict[int, np.ndarray], eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            vectors = rows.column(2).to_pylist()
            dims = np.array([len(v) for v in vectors])
            cells = np.zeros((len(vectors), _AXES), np.int32)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                if d in axes:
                    c = _unit(np.array([vectors[i] for i in own], np.float64)) @ axes[d]
                    cells[own, : c.shape[1]] = np.floor(c / eps)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(dims, pa.int32()), *(pa.array(cells[:, k]) for k in range(_AXES))], [*rows.schema.names, "dim", *(f"c{k}" for k in range(_AXES))])

    return run


_BLOCKS = "part int, block int, dim int, n long, lo array<double>, hi array<double>, nodes binary, copies binary, vectors binary"


def _cut(axes: dict[int, np.ndarray], kind: str, most: int = _BLOCK):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal block, held
            x = np.array([h[2] for h in held], kind)
            u = _unit(x.astype(np.float64))
            d = x.shape[1]
            c = u @ axes[d] if d in axes else np.zeros((len(u), 0))
            rest = np.sqrt(np.maximum(0.0, 1.0 - (c * c).sum(axis=1)))[:, None]  # the length off the axes is a coordinate too
            box = np.hstack([c, np.zeros((len(u), _AXES - c.shape[1])), rest])
            row = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([d], pa.int32()), pa.array([len(held)], pa.int64()),
                    pa.array([box.min(axis=0).tolist()], pa.list_(pa.float64())), pa.array([box.max(axis=0).tolist()], pa.list_(pa.float64())),
                    pa.array([np.array([h[0] for h in held], np.int64).tobytes()], pa.binary()), pa.array([np.array([h[1] for h in held], np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary()),
                ],
                ["part", "block", "dim", "n", "lo", "hi", "nodes", "copies", "vectors"],
            )
            block, held = block + 1, []
            return row

        for rows in batches:
            for i in range(0, rows.num_rows, 1024):
                piece = rows.slice(i, 1024)
                for item in zip(*(piece.column(k).to_pylist() for k in range(3)), strict=True):
                    if held and (len(held) >= most or len(held[-1][2]) != len(item[2])):
                        yield close()
                    held.append(item)
        if held:
            yield close()

    return run


def _far(a: str, b: str, eps: float) -> Column:
    """Whether two boxes are surely more than ``eps`` apart."""
    gaps = F.zip_with(
        F.zip_with(f"{a}.lo", f"{b}.hi", lambda x, y: F.greatest(x - y, F.lit(0.0))),
        F.zip_with(f"{b}.lo", f"{a}.hi", lambda x, y: F.greatest(x - y, F.lit(0.0))),
        lambda x, y: F.greatest(x, y),
    )
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) > (eps + 1e-6) ** 2


def _block_pairs(boxes: DataFrame, count: int, eps: float) -> DataFrame:
    """Pairs ``(i, j)`` of blocks, ``i <= j``, left by the recursion over intervals of 8, 64, 512 … blocks."""
    top = 0
    while _FAN**top < count:
        top += 1
    pairs = boxes.sparkSession.createDataFrame([(0, 0)], "i long, j long")
    for level in range(top - 1, -1, -1):
        width = _FAN**level
        at = F.floor(F.col("seq") / width).cast("long")
        box = boxes.groupBy(at.alias("id"), "dim").agg(
            F.array(*(F.min(F.col("lo")[k]) for k in range(_AXES + 1))).alias("lo"), F.array(*(F.max(F.col("hi")[k]) for k in range(_AXES + 1))).alias("hi")
        )
        # an interval may hold several lengths of vectors; each has a box of its own
        part = box.select("id", F.struct("dim", "lo", "hi").alias("b")).withColumn("up", F.floor(F.col("id") / _FAN).cast("long"))
        left = part.select(F.col("up").alias("i"), F.col("id").alias("ci"), F.col("b").alias("bi"))
        right = part.select(F.col("up").alias("j"), F.col("id").alias("cj"), F.col("b").alias("bj"))
        near = pairs.join(left, "i").join(right, "j").where("ci <= cj and bi.dim = bj.dim").where(~_far("bi", "bj", eps))
        pairs = near.select(F.col("ci").alias("i"), F.col("cj").alias("j")).distinct()
    return pairs


def _pair_edges(i: dict, j: dict, kind: str, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Vectors of a pair of blocks with the node that each is joined to and the number of its links here; None without any."""
    same = i["seq"] == j["seq"]
    cos = i["unit"] @ j["unit"].T
    near = cos >= least
    a, b = np.nonzero(np.abs(cos - least) < 1e-4)
    for s in range(0, len(a), 65536):
        p, q = (_raw(x, kind)[at[s : s + 65536]].astype(np.float64) for x, at in ((i, a), (j, b)))
        p, q = p / np.abs(p).max(axis=1, keepdims=True), q / np.abs(q).max(axis=1, keepdims=True)
        exact = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
        near[a[s : s + 65536], b[s : s + 65536]] = exact >= least
    if same:
        np.fill_diagonal(near, False)
    of_i, of_j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    if not len(of_i):
        return None
    small = near[np.ix_(of_i, of_j)]
    if same:
        own, links = i["nodes"][of_i], small @ j["copies"][of_j]
        m, root = forest(small)
    else:
        own = np.concatenate([i["nodes"][of_i], j["nodes"][of_j]])
        links = np.concatenate([small @ j["copies"][of_j], small.T @ i["copies"][of_i]])
        both = np.zeros((len(own), len(own)), bool)
        both[: len(of_i), len(of_i) :] = small
        both[len(of_i) :, : len(of_i)] = small.T
        m, root = forest(both)
    to = own.copy()
    to[m] = own[root]
    return own, to, links.astype(np.int64)


def _raw(block: dict, kind: str) -> np.ndarray:
    return np.frombuffer(block["vectors"], kind).reshape(len(block["nodes"]), -1)


def _compare(kind: str, least: float):
    """The pairs of sorted ``tile, seq, partners, nodes, copies, vectors`` rows; a tile has the blocks of two bands, 16 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}

        def compared() -> Iterator[pa.RecordBatch]:
            for block in held.values():
                for other in block["partners"]:
                    if found := _pair_edges(block, held[other], kind, least):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["a", "b", "links"])

        for rows in batches:
            for k in range(rows.num_rows):
                r = {name: rows.column(name)[k].as_py() for name in rows.schema.names}
                if r["tile"] != tile:
                    yield from compared()
                    tile, held = r["tile"], {}
                block = {"seq": r["seq"], "partners": r["partners"], "nodes": np.frombuffer(r["nodes"], np.int64), "copies": np.frombuffer(r["copies"], np.int64), "vectors": r["vectors"]}
                block["unit"] = _unit(_raw(block, kind).astype(np.float64)).astype(np.float32)
                held[r["seq"]] = block
        yield from compared()

    return run


def _tiled(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks with their partners by tile: all pairs of two bands of eight blocks, so that a block goes once to each band that it meets."""
    banded = pairs.withColumn("tile", F.xxhash64(F.floor(F.col("i") / _FAN), F.floor(F.col("j") / _FAN)))
    # at most eight partners a row
    active = banded.groupBy("tile", F.col("i").alias("seq")).agg(F.collect_list("j").alias("partners"))
    passive = banded.select("tile", F.col("j").alias("seq"), F.expr("cast(array() as array<bigint>)").alias("partners"))
    rows = active.unionByName(passive).groupBy("tile", "seq").agg(F.flatten(F.collect_list("partners")).alias("partners"))
    placed = rows.join(blocks.select("seq", "nodes", "copies", "vectors"), "seq").select("tile", "seq", "partners", "nodes", "copies", "vectors")
    return placed.repartition("tile").sortWithinPartitions("tile")


def near_vectors(vectors: DataFrame, least: float = 0.9, sample: int = 4096) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    spark = vectors.sparkSession
    wide = vectors.schema["embedding"].dataType.elementType.typeName() != "float"  # integers and decimals are taken as doubles
    element, kind = ("double", "<f8") if wide else ("float", "<f4")
    eps = float(np.sqrt(2 - 2 * least))
    e = F.col("embedding")
    # NaN compares as above every number in Spark, so the bounds also leave it out
    bound = F.lit(1.7e308 if wide else 3.4028235e38).cast("double")
    good = F.coalesce(F.forall(e, lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= bound)) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = common.settle(
        vectors.select("vec_id", e.cast(f"array<{element}>").alias("embedding"), F.coalesce(good, F.lit(False)).alias("good"))
        .withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding"), "row": F.monotonically_increasing_id()}),
        "vectors",
    )
    first = F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id"))
    nodes = common.settle(rows.where("good").groupBy("h1", "h2").agg(F.min("row").alias("node"), F.count("*").alias("copies"), first.alias("first"), F.first("embedding").alias("embedding")), "vector-nodes")
    axes: dict[int, np.ndarray] = {}
    some: dict[int, list] = {}
    for v in nodes.orderBy("h1", "h2").limit(sample).select("embedding").toArrow().column(0).to_pylist():
        some.setdefault(len(v), []).append(v)
    for d, vs in some.items():
        axes[d] = _principal(np.array(vs, np.float64))
    cells = [f"c{k}" for k in range(_AXES)]
    placed = nodes.select("node", "copies", "embedding").mapInArrow(_place(axes, eps), f"node long, copies long, embedding array<{element}>, dim int, {', '.join(f'{c} int' for c in cells)}")
    ordered = placed.repartitionByRange("dim", *cells, "node").sortWithinPartitions("dim", *cells, "node")
    blocks = common.settle(ordered.select("node", "copies", "embedding").mapInArrow(_cut(axes, kind), _BLOCKS), "vector-blocks")
    # number the blocks in sequence: a running sum over one row per writing task
    parts = blocks.groupBy("part").agg(F.count("*").alias("k"))
    begins = parts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("begin"))
    numbered = blocks.join(F.broadcast(begins), "part").withColumn("seq", F.col("begin") + F.col("block"))
    pairs = _block_pairs(numbered.select("seq", "dim", "lo", "hi"), max(1, blocks.count()), eps)
    found = common.settle(_tiled(common.settle(pairs, "vector-pairs"), numbered).mapInArrow(_compare(kind, least), "a long, b long, links long"), "vector-links")
    links = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(found)
    info = nodes.select("h1", "h2", "node", "copies", "first").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    info = common.settle(info, "vector-labels")
    # written first, so that neither side of the join is bound to the grouping and a large component can be split
    named = common.settle(info.groupBy("root").agg(F.min("first").alias("lead")), "vector-leads")
    by_content = info.join(named, "root").select("h1", "h2", F.lit(True).alias("good"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.col("lead.vec_id").alias("lead"))
    joined = rows.select("vec_id", "h1", "h2", "good").join(by_content, ["h1", "h2", "good"], "left")
    component = F.when(F.col("good"), F.col("lead")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
