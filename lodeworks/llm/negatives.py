"""Hard negatives by blocked dense matrix products over integer vectors.

Components become ``floor(256 * x)``; products are taken in double precision, which is exact while no sum can reach
2^53, and beyond that in Python's integers. Blocks of anchors are sent to every cell of blocks of candidates
(``tiles.meet``). The first pass keeps for each anchor and tile the five best rows of the anchor's label, which merge by
taking the best five again; the second pass has the five windows of scores beside each anchor and keeps for each the
three best rows of other labels within it, which merge alike.

Defined cases: rows with a null label, a null or empty vector, or a null or non-finite component take no part; vectors of
different lengths never meet; a row without an id is never an anchor, comes after all others in ties and is given out as
null; repeated rows are rows of their own (an anchor's copy is one of its positives, two equal anchors have each their
own results); an anchor without positives, or a positive whose window is empty, gives no row; an empty table gives no
rows; columns besides ``vec_id``, ``embedding`` and ``label`` are not read; a score beyond a long is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm import common
from lodeworks.operators.tiles import Block, blocks, firsts, front, meet

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
_ANCHORS, _CANDIDATES = 256, 2048
_EXACT = 2.0**53


def usable(vector: str) -> Column:
    """Whether a vector has components, none of them null or not finite."""
    number = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(number & (F.size(vector) > 0), F.lit(False))


def integers(vector: str) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, as doubles where these hold every sum exactly."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < _EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return longs(a.astype(object) @ b.astype(object).T)


def longs(exact: np.ndarray) -> np.ndarray:
    """Python's integers as longs; one beyond a long (or the least of them, which has no opposite) is an OverflowError."""
    out = exact.astype(np.int64)
    if (out == np.iinfo(np.int64).min).any():
        raise OverflowError("a score is beyond a long")
    return out


def _masked(scores: np.ndarray, keep: np.ndarray) -> np.ndarray:
    return np.where(keep, scores, -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min)


def numbered_rows(vectors: DataFrame, columns: dict[str, Column], name: str) -> DataFrame:
    """Usable rows as ``row`` (a number of its own), ``key`` (the id, the greatest long for none), ``none`` and ``v``, settled."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", *(c.alias(n) for n, c in columns.items())).where(usable("embedding"))
    return common.settle(
        rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit((1 << 63) - 1)).alias("key"), F.col("vec_id").isNull().cast("long").alias("none"), *columns, integers("embedding").alias("v")), name
    )


def _ordered(block: Block) -> np.ndarray:
    """The order of a block's rows by id, then row."""
    return np.lexsort((block.numbers[0], block.numbers[1]))


def _positives(held: list[Block], others: Iterator[Block]) -> Iterator[pa.RecordBatch]:
    found: list[tuple[np.ndarray, ...]] = []
    for other in others:
        order = _ordered(other)
        row, key, none, label = (n[order] for n in other.numbers[:4])
        x = other.vectors[order]
        for block in held:
            if block.width == other.width:
                own = (block.numbers[3][:, None] == label) & (block.numbers[0][:, None] != row)
                if own.any():
                    s = _masked(products(block.vectors, x), own)
                    i, j = firsts(s, POSITIVES)
                    found.append((block.numbers[0][i], s[i, j].astype(np.int64), key[j], row[j], none[j]))
    if found:
        anchor, score, key, row, none = (np.concatenate(c) for c in zip(*found, strict=True))
        at = front([anchor], [-score, key, row], POSITIVES)
        yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (anchor, score, key, row, none)], ["anchor", "score", "key", "row", "none"])


def _negatives(held: list[Block], others: Iterator[Block]) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors have their windows after the first four columns: five lower bounds, then five upper ones."""
    found: list[tuple[np.ndarray, ...]] = []
    for other in others:
        order = _ordered(other)
        row, key, none, label = (n[order] for n in other.numbers[:4])
        x = other.vectors[order]
        for block in held:
            if block.width != other.width:
                continue
            low, high = np.stack(block.numbers[4 : 4 + POSITIVES], axis=1), np.stack(block.numbers[4 + POSITIVES :], axis=1)
            some = low <= high
            top = np.iinfo(np.int64)
            least, most = np.where(some, low, top.max).min(axis=1), np.where(some, high, top.min).max(axis=1)
            s = products(block.vectors, x)
            i, j = np.nonzero((s >= least[:, None]) & (s <= most[:, None]) & (block.numbers[3][:, None] != label))
            value = s[i, j].astype(np.int64)
            for w in range(POSITIVES):
                inside = np.flatnonzero((value >= low[i, w]) & (value <= high[i, w]))
                at = inside[front([i[inside]], [-value[inside], j[inside]], NEGATIVES)]
                found.append((block.numbers[0][i[at]], np.full(len(at), w + 1, np.int32), value[at], key[j[at]], row[j[at]], none[j[at]]))
    if found:
        anchor, window, score, key, row, none = (np.concatenate(c) for c in zip(*found, strict=True))
        at = front([anchor, window], [-score, key, row], NEGATIVES)
        yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (anchor, window, score, key, row, none)], ["anchor", "window", "score", "key", "row", "none"])


def _id(none: str, key: str) -> Column:
    return F.when(F.col(none) == 0, F.col(key))


def hard_negatives(vectors: DataFrame, label: Column | None = None, anchor: Column | None = None) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor and its positives.

    ``label`` and ``anchor`` are expressions over the columns of ``vectors``: the label that counts, and whether a row is
    an anchor (by default the column ``label``, and every 50th id).
    """
    label = (F.col("label") if label is None else label).cast("long")
    anchor = F.coalesce(F.col("vec_id") % 50 == 0 if anchor is None else anchor, F.lit(False)) & F.col("vec_id").isNotNull()
    rows = numbered_rows(vectors.where(label.isNotNull()), {"label": label, "anchor": anchor}, "negatives-rows")
    columns = ["row", "key", "none", "label"]
    candidates = blocks(rows, "v", columns, size=_CANDIDATES, kind="<i8", name="negatives-candidates")
    anchors = rows.where("anchor")
    kinds = ("<i8", "<i8")
    first = meet(blocks(anchors, "v", columns, size=_ANCHORS, kind="<i8", name="negatives-anchors"), candidates, _positives, "anchor long, score long, key long, row long, none long", kinds)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "key", "row")
    positives = common.settle(first.withColumn("window", F.row_number().over(best)).where(F.col("window") <= POSITIVES), "negatives-positives")
    # 50 p <= 100 n <= 95 p over integers; a window without whole numbers stays empty
    bounds = positives.select("anchor", "window", F.ceil(F.col("score") / F.lit(2).cast("decimal(2,0)")).cast("long").alias("low"), F.floor(F.col("score").cast("decimal(21,0)") * 95 / 100).cast("long").alias("high"))
    sides = [F.max(F.when(F.col("window") == w, F.col(side))).alias(f"{side}{w}") for side in ("low", "high") for w in range(1, POSITIVES + 1)]
    windows = bounds.groupBy(F.col("anchor").alias("row")).agg(*sides)
    edges = [F.coalesce(f"{side}{w}", F.lit(1 if side == "low" else 0)).alias(f"{side}{w}") for side in ("low", "high") for w in range(1, POSITIVES + 1)]
    asked = anchors.join(windows, "row").select(*columns, "v", *edges)
    names = columns + [f"{side}{w}" for side in ("low", "high") for w in range(1, POSITIVES + 1)]
    second = meet(blocks(asked, "v", names, size=_ANCHORS, kind="<i8", name="negatives-windows"), candidates, _negatives, "anchor long, window int, score long, key long, row long, none long", kinds)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "key", "row")
    chosen = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES).select("anchor", "window", "rank", _id("none", "key").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"))
    named = positives.select("anchor", "window", _id("none", "key").alias("positive_id"), F.col("score").alias("positive_score")).join(ids, "anchor")
    return named.join(chosen, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(common.table(spark, sf_dir, "embeddings"), label)


_ROWS = """v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS aid, a.label AS al, c.r, c.vec_id, c.label, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON len(a.e) = len(c.e) AND a.r <> c.r WHERE a.vec_id % 50 = 0)"""

OP13_SQL = f"""WITH {_ROWS},
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) AS k FROM s WHERE al = label) WHERE k <= 5),
n AS (SELECT p.aid, p.vec_id AS pid, p.score AS ps, s.vec_id AS nid, s.score AS ns, row_number() OVER (PARTITION BY p.ar, p.k ORDER BY s.score DESC, s.vec_id, s.r) AS k
  FROM p JOIN s ON s.ar = p.ar AND s.label <> p.al AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT aid AS anchor_id, pid AS positive_id, CAST(k AS INTEGER) AS rank, nid AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 3"""
