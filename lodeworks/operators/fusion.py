"""Merging ranked lists: rank fusion, anchors, round robin, deduplication and diversification.

Ranked lists are rows ``(qid, rank, id, …)`` with ranks from 1; ties are always broken by stated columns.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plain_rrf(lists: DataFrame, k: int = 60, digits: int = 9) -> DataFrame:
    """``qid, rank, id, score`` from rows ``(qid, list, rank, id)``: the sum of ``1 / (k + rank)``."""
    fused = lists.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), digits).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return fused.withColumn("rank", F.row_number().over(w)).select("qid", "rank", "id", "score")


def weighted_rrf(dense: DataFrame, sparse: DataFrame, w_dense: float = 1.5, w_sparse: float = 1.0, k: int = 5, anchors: int = 0, limit: int | None = None, digits: int = 9) -> DataFrame:
    """Weighted rank fusion of two lists with the first ``anchors`` dense hits pinned on top.

    Order: anchors by dense rank, then by score descending, dense rank, sparse rank (absent: one past the list's end).
    The score is therefore not monotone in rank. Returns ``qid, rank, id, score, dense_rank, sparse_rank``.
    """
    if not (w_dense > 0 and w_sparse > 0 and k >= 1 and anchors >= 0):
        raise ValueError("weights and k must be positive, anchors not negative")
    d = dense.select("qid", "id", F.col("rank").alias("dense_rank"))
    s = sparse.select("qid", "id", F.col("rank").alias("sparse_rank"))
    ends = F.max("dense_rank").over(Window.partitionBy("qid")).alias("d_end"), F.max("sparse_rank").over(Window.partitionBy("qid")).alias("s_end")
    part = lambda w, r: F.when(F.col(r).isNull(), F.lit(0.0)).otherwise(w / (k + F.col(r)))
    joined = d.join(s, ["qid", "id"], "full").select("*", *ends).withColumn("score", F.round(part(w_dense, "dense_rank") + part(w_sparse, "sparse_rank"), digits))
    pinned = F.coalesce(F.col("dense_rank") <= anchors, F.lit(False))
    order = [
        F.when(pinned, F.col("dense_rank")).asc_nulls_last(),
        F.desc("score"),
        F.coalesce("dense_rank", F.coalesce("d_end", F.lit(0)) + 1),
        F.coalesce("sparse_rank", F.coalesce("s_end", F.lit(0)) + 1),
        F.col("id"),
    ]
    ranked = joined.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    out = ranked.select("qid", "rank", "id", "score", "dense_rank", "sparse_rank")
    return out.where(F.col("rank") <= limit) if limit else out


def weighted_scores(dense: DataFrame, sparse: DataFrame, w_dense: float, w_sparse: float, digits: int = 9) -> DataFrame:
    """Weighted sum of min-max normalised scores (higher is better in both); a constant list counts 1.

    The normalisation of the servers that offer this is not published; this one is stated and is an approximation.
    """

    def scaled(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("qid")
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        return df.select("qid", "id", F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / (hi - lo)).alias(name))

    joined = scaled(dense, "d").join(scaled(sparse, "s"), ["qid", "id"], "full")
    score = F.round(w_dense * F.coalesce("d", F.lit(0.0)) + w_sparse * F.coalesce("s", F.lit(0.0)), digits)
    fused = joined.select("qid", "id", score.alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).select("qid", "rank", "id", "score")


def first_wins(rows: DataFrame, identity: Column, partition: list[str], position: list[str]) -> DataFrame:
    """Of rows with an equal identity the first by position; the survivor is stated, unlike ``dropDuplicates``."""
    w = Window.partitionBy(*partition, identity).orderBy(*position)
    return rows.withColumn("first_", F.row_number().over(w)).where("first_ = 1").drop("first_")


def identity(policy: str, text: Column, source: Column, page: Column, chunk: Column, url: Column | None = None, is_web: Column | None = None) -> Column:
    """Identity of a hit: web hits by URL; others by text, or by source, page, chunk and text."""
    normal = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    if policy == "text":
        own = F.concat(F.lit("text|"), normal)
    elif policy == "source_chunk":
        clean = F.lower(F.replace(F.coalesce(source, F.lit("")), F.lit("\\"), F.lit("/")))
        own = F.concat_ws("|", F.lit("source_chunk"), clean, F.coalesce(page.cast("string"), F.lit("")), F.coalesce(chunk.cast("string"), F.lit("")), normal)
    else:
        raise ValueError(f"unknown identity policy {policy}")
    if url is None or is_web is None:
        return own
    return F.when(is_web, F.concat(F.lit("web|"), F.lower(F.trim(url)))).otherwise(own)


def _anchored(groups: DataFrame, first: int, others: int) -> DataFrame:
    """Anchors of ``(qid, grp, rank, id)``: the first hits of group 0 and of each other group, deduplicated, in order."""
    pool = groups.where((F.col("grp") == 0) & (F.col("rank") <= first) | (F.col("grp") > 0) & (F.col("rank") <= others))
    once = first_wins(pool, F.col("id"), ["qid"], ["grp", "rank"])
    return once.withColumn("anchor", F.row_number().over(Window.partitionBy("qid").orderBy("grp", "rank")))


def round_robin(groups: DataFrame, first: int = 0, others: int = 0) -> DataFrame:
    """``qid, pos, id`` merging groups rank by rank, after anchors; every identity once."""
    anchors = _anchored(groups, first, others).select("qid", "id", "anchor")
    once = first_wins(groups, F.col("id"), ["qid"], ["rank", "grp"])
    w = Window.partitionBy("qid").orderBy(F.col("anchor").asc_nulls_last(), "rank", "grp")
    return once.join(anchors, ["qid", "id"], "left").withColumn("pos", F.row_number().over(w)).select("qid", "pos", "id")


def cross_query_rrf(groups: DataFrame, k: int = 5, first: int = 1, others: int = 1, digits: int = 9) -> DataFrame:
    """``qid, pos, id, score, anchored``: rank fusion over query groups behind the anchors.

    Ties: rank in the first group that holds the identity, that group, then the identity.
    """
    anchors = _anchored(groups, first, others).select("qid", "id", "anchor")
    best = first_wins(groups, F.concat_ws("|", "grp", "id"), ["qid"], ["rank"])
    scored = best.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (F.greatest(F.lit(k), F.lit(1)) + F.col("rank"))), digits).alias("score"), F.min(F.struct("grp", "rank")).alias("seen"))
    w = Window.partitionBy("qid").orderBy(F.col("anchor").asc_nulls_last(), F.desc("score"), "seen.rank", "seen.grp", "id")
    joined = scored.join(anchors, ["qid", "id"], "left")
    return joined.withColumn("pos", F.row_number().over(w)).select("qid", "pos", "id", "score", F.col("anchor").isNotNull().alias("anchored"))


def diversify_documents(hits: DataFrame, limit: int, anchors: int = 0) -> DataFrame:
    """Unseen documents first, in order; then the rest, in order. Rows ``(qid, pos, id, doc)``; the first ``anchors`` stay."""
    own = Window.partitionBy("qid", "doc").orderBy("pos")
    again = F.when(F.col("pos") <= anchors, F.lit(0)).when(F.row_number().over(own) == 1, F.lit(1)).otherwise(F.lit(2))
    ordered = hits.withColumn("turn", again).withColumn("new_pos", F.row_number().over(Window.partitionBy("qid").orderBy("turn", "pos")))
    return ordered.where(F.col("new_pos") <= limit).select("qid", F.col("new_pos").alias("pos"), "id", "doc")


def diversify_near_ties(hits: DataFrame, tolerance: float) -> DataFrame:
    """Greedy: of the hits left within ``tolerance`` of the best, the first of an unseen document, else the best.

    Each choice depends on all before it, so a query's hits (a ranked list, bounded by its limit) are taken together.
    Rows ``(qid, rank, id, doc, score)``; also at tolerance 0 exact ties are reordered.
    """

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf.sort_values("rank").to_dict("records")
        seen: set = set()
        out = []
        while left:
            best = left[0]["score"]
            close = [i for i, h in enumerate(left) if h["score"] >= best * (1 - tolerance)]
            at = next((i for i in close if left[i]["doc"] not in seen), 0)
            hit = left.pop(at)
            seen.add(hit["doc"])
            out.append((hit["qid"], len(out) + 1, hit["id"], hit["doc"], hit["score"]))
        return pd.DataFrame(out, columns=["qid", "rank", "id", "doc", "score"])

    return hits.select("qid", "rank", "id", "doc", "score").groupBy("qid").applyInPandas(greedy, "qid long, rank long, id long, doc long, score double")


def guard_anchors(selected: DataFrame, groups: DataFrame, limit: int = 20) -> DataFrame:
    """Append each group's head where it is missing from ``selected(qid, pos, id)``, up to ``limit``."""
    heads = first_wins(groups.where("rank = 1"), F.col("id"), ["qid"], ["grp"])
    missing = heads.join(selected.select("qid", "id"), ["qid", "id"], "left_anti").select("qid", F.lit(1).alias("late"), F.col("grp").cast("long").alias("at"), "id")
    both = selected.select("qid", F.lit(0).alias("late"), F.col("pos").cast("long").alias("at"), "id").unionByName(missing)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("late", "at"))).where(F.col("pos") <= limit).select("qid", "pos", "id")


def evidence_budget(hits: DataFrame, tokens: Column, most: int = 8, each: int = 1200, total: int = 10_000) -> DataFrame:
    """The ordered prefix of ``hits(qid, pos, …)`` within the budget; ``granted`` is what the last block is cut to."""
    w = Window.partitionBy("qid").orderBy("pos")
    capped = hits.withColumn("tokens", F.least(tokens, F.lit(each)))
    before = F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return capped.withColumn("before", before).where((F.col("pos") <= most) & (F.col("before") < total)).withColumn("granted", F.least("tokens", F.lit(total) - F.col("before"))).drop("before")


def batch_rerank(candidates: DataFrame, answers: DataFrame, size: int = 10) -> DataFrame:
    """``candidates(qid, pos, id)`` that a model's answers keep, with ``place``; each batch of ``size`` is judged apart.

    ``answers(qid, batch, chosen array<int>, broken boolean)``: indices within the batch, in the order preferred. Indices
    outside the batch and repeated ones are left out. A batch without an answer, with a broken one, or of whose indices
    none is valid although some were given keeps all its candidates in order; an empty answer keeps none.
    """
    at = F.row_number().over(Window.partitionBy("qid").orderBy("pos", "id")) - 1
    placed = candidates.withColumn("at_", at).withColumns({"batch": F.floor(F.col("at_") / size).cast("int"), "index_": (F.col("at_") % size).cast("int")})
    sizes = placed.groupBy("qid", "batch").agg(F.count("*").cast("int").alias("n_"))
    told = sizes.join(answers.select("qid", "batch", "chosen", "broken"), ["qid", "batch"], "left")
    valid = F.array_distinct(F.filter("chosen", lambda i: (i >= 0) & (i < F.col("n_"))))
    keep_all = F.col("chosen").isNull() | F.coalesce("broken", F.lit(False)) | ((F.size("chosen") > 0) & (F.size(valid) == 0))
    kept = told.select("qid", "batch", F.posexplode(F.when(keep_all, F.sequence(F.lit(0), F.col("n_") - 1)).otherwise(valid)).alias("order_", "index_"))
    joined = placed.join(kept, ["qid", "batch", "index_"])
    return joined.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("batch", "order_"))).drop("at_", "batch", "index_", "order_")
