"""Vector and lexical retrieval: exact top-k under several metrics, BM25, collection-wise search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.operators.tiles import Block, blocks, firsts, front, meet
from lodeworks.session import settle

#: Which metric names order upwards (distances) and which downwards (similarities).
DISTANCES = ("L2", "EUCLID", "EUCLIDEAN", "MANHATTAN", "JACCARD", "HAMMING")
SIMILARITIES = ("COSINE", "IP", "INNER_PRODUCT", "DOT", "DOT_PRODUCT")


def score_kind(metric: Column) -> Column:
    """``distance``, ``similarity`` or ``rank_score`` of a metric name."""
    name = F.upper(F.trim(metric))
    return F.when(name.isin(*DISTANCES), "distance").when(name.isin(*SIMILARITIES), "similarity").otherwise("rank_score")


def _scores(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of every query (rows) for every vector; larger is better for similarities only."""
    dot = q @ x.T
    if metric == "ip":
        return dot
    qq, xx = (q * q).sum(axis=1)[:, None], (x * x).sum(axis=1)[None, :]
    if metric in ("cosine", "cosine_distance"):
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = dot / (np.sqrt(qq) * np.sqrt(xx))
        return 1 - cosine if metric == "cosine_distance" else cosine
    square = np.maximum(qq + xx - 2 * dot, 0)
    if metric == "l2":
        return np.sqrt(square)
    if metric == "l2_squared":
        return square
    if metric == "manhattan":
        return np.stack([np.abs(x - row).sum(axis=1) for row in q])
    raise ValueError(f"unknown metric {metric}")


def dense_topk(
    queries: Sequence[tuple[int, Sequence[float]]], corpus: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding", max_distance: float | None = None, digits: int = 6
) -> DataFrame:
    """``qid, rank, id, score``: the ``k`` best vectors for each of a stated set of queries.

    The query set is an argument and so bounded by what its caller holds. Each Arrow batch of the corpus is compared as a
    matrix product and keeps its own ``k`` best per query, so the shuffle carries ``k`` rows per query and batch, never
    the product. Scores are rounded before they are ranked; ties go to the lower id. Null vectors, vectors of another
    length and undefined scores are left out.
    """
    if not queries:
        return corpus.sparkSession.createDataFrame([], "qid long, rank int, id long, score double")
    qids = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64)
    lower = metric not in ("cosine", "ip")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, vectors = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            own = [i for i, v in enumerate(vectors) if v is not None and len(v) == matrix.shape[1] and None not in v and ids[i] is not None]
            if not own:
                continue
            x = np.array([vectors[i] for i in own], np.float64)
            idv = np.array([ids[i] for i in own], np.int64)
            s = np.round(_scores(metric, matrix, x), digits)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for r in range(len(qids)):
                ok = np.isfinite(s[r])
                if max_distance is not None:
                    ok &= s[r] < max_distance
                at = np.flatnonzero(ok)
                order = at[np.lexsort((idv[at], s[r][at] if lower else -s[r][at]))][:k]
                out.append((np.full(len(order), qids[r]), idv[order], s[r][order]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], ["qid", "id", "score"])

    found = corpus.select(F.col(id_col).cast("long"), vector_col).mapInArrow(best, "qid long, id long, score double")
    value = F.col("score") if lower else -F.col("score")
    w = Window.partitionBy("qid").orderBy(value, "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "id", (F.col("score") + 0.0).alias("score"))


def dense_topk_rows(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vector_col: str = "embedding", by: str | None = None, max_distance: float | None = None, digits: int = 6) -> DataFrame:
    """``qid, rank, id, score`` (and ``by``) of every row of ``queries`` against every row of ``corpus``, in tiles.

    Both sides are packed into blocks and dealt out by pairs of groups of blocks (``tiles.meet``); each pair of blocks is
    one matrix product and a tile gives ``k`` rows per query (and value of ``by``), so no side is gathered or broadcast
    and products are never shuffled. Ranks are within a query, or within a query and value of ``by``. Scores are rounded
    before they are ranked; ties go to the lower id. Rows without an id, a vector or a value of ``by``, vectors of
    another width and undefined scores are left out; a repeated query id gives one ranking of all its vectors' hits.
    """
    lower = metric not in ("cosine", "ip")
    own = [by] if by else []
    left = blocks(queries.where(F.col(id_col).isNotNull()), vector_col, [id_col], size=512, name="queries")
    right = blocks(corpus.where(F.col(id_col).isNotNull()).dropna(subset=own) if own else corpus.where(F.col(id_col).isNotNull()), vector_col, [id_col], own, name="corpus")

    def best(held: list[Block], others: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, ...]] = []
        for other in others:
            order = np.argsort(other.numbers[0], kind="stable")
            ids, x = other.numbers[0][order], other.vectors[order]
            names = np.array(other.texts[0], object)[order] if own else np.full(len(ids), "", object)
            parts = [(g, np.flatnonzero(names == g)) for g in sorted(set(names))]
            for block in held:
                if block.width != other.width:
                    continue
                s = np.round(_scores(metric, block.vectors, x), digits)
                s[~np.isfinite(s) | (s >= max_distance if max_distance is not None else False)] = np.inf if lower else -np.inf
                s = -s if lower else s
                for g, at in parts:
                    rows, columns = firsts(s[:, at], k)
                    found.append((block.numbers[0][rows], np.full(len(rows), g, object), ids[at][columns], s[rows, at[columns]]))
        if found:
            qids, gs, ids, s = (np.concatenate(c) for c in zip(*found, strict=True))
            at = front([qids, np.unique(gs.astype(str), return_inverse=True)[1]], [-s, ids], k)
            yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(gs[at], pa.string()), pa.array(ids[at]), pa.array(-s[at] if lower else s[at])], ["qid", "g", "id", "score"])

    found = meet(left, right, best, "qid long, g string, id long, score double")
    value = F.col("score") if lower else -F.col("score")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid", "g").orderBy(value, "id"))).where(F.col("rank") <= k)
    columns = ["qid", "rank", "id", (F.col("score") + 0.0).alias("score")]
    return ranked.select(*columns, F.col("g").cast(corpus.schema[by].dataType).alias(by)) if by else ranked.select(*columns)


def per_collection(hits: DataFrame, collection: str, position: str, k: int, score: str = "score", lower: bool = False) -> DataFrame:
    """Top-k of every collection, concatenated in collection order without sorting across collections."""
    value = F.col(score) if lower else -F.col(score)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid", collection).orderBy(value, "id"))).where(F.col("rank") <= k)
    return ranked.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(position, "rank")))


def terms(text: Column) -> Column:
    """Lower-cased ASCII letter-digit runs."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def bm25_impacts(docs: DataFrame, vocabulary: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``term, id, s``: an inverted index of ``docs(id, text)`` over the terms of ``vocabulary(term)``, with BM25 impacts.

    One pass over the texts: each gives a row under the empty term, which carries its length, and rows for the terms that
    are asked for. The vocabulary is written first, so that Spark knows its size when it chooses how to join; postings
    are written before they are read as counts and as impacts. A null text has no terms and length 0.
    """
    wanted = settle(vocabulary.select("term").where("term is not null").distinct().unionByName(docs.sparkSession.createDataFrame([("",)], "term string")), "bm25-vocabulary")
    toks = docs.select("id", terms(F.coalesce("text", F.lit(""))).alias("t"))
    exploded = toks.select("id", F.size("t").alias("len"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    postings = settle(exploded.join(wanted, "term", "left_semi").groupBy("term", "id", "len").agg(F.count("*").alias("tf")), "bm25-postings")
    corpus = postings.where("term = ''").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    terms_only = postings.where("term <> ''")
    df = terms_only.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    s = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return terms_only.join(df.crossJoin(F.broadcast(corpus)), "term").select("term", "id", s.alias("s"))  # corpus is a single row


def query_terms(queries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, term``: each term of a query's ``text`` once."""
    return queries.select(*keys, F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term")).distinct()


def bm25_search(impacts: DataFrame, asked: DataFrame, keys: Sequence[str], k: int, digits: int = 6) -> DataFrame:
    """``keys, rank, id, score``: the ``k`` best texts for each query of ``asked(keys, term)``; ties go to the lower id.

    Queries are numbered first, so that sums are kept by two numbers. Impacts of asked terms are dealt out by text before
    queries multiply them, so all of a text's sums are made in one task and only the best of each task move on.
    """
    wanted = settle(asked.groupBy(*keys).agg(F.collect_set("term").alias("terms")).withColumn("query_", F.monotonically_increasing_id()), "bm25-queries")
    terms_ = wanted.select("query_", F.explode("terms").alias("term"))
    dealt = impacts.join(terms_.select("term").distinct(), "term", "left_semi").repartition("id")
    totals = dealt.join(terms_, "term").groupBy("query_", "id").agg(F.round(F.sum("s"), digits).alias("score"))
    best = totals.withColumn("rank", F.row_number().over(Window.partitionBy("query_").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return best.join(wanted.select("query_", *keys), "query_").select(*keys, "rank", "id", "score")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """``qid, rank, id, score`` by BM25 over ``docs(id, text)`` and ``queries(qid, text)``; ``k1`` and ``b`` are the usual defaults."""
    asked = query_terms(queries, ["qid"])
    return bm25_search(bm25_impacts(docs, asked, k1, b), asked, ["qid"], k, digits)


def evidence_source_count(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct sources per query; a source is the first of ``keys`` that is not null."""
    return hits.groupBy("qid").agg(F.countDistinct(F.coalesce(*keys)).alias("n_sources"))
