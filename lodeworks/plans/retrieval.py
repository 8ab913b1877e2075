"""Named queries over retrieval and fusion operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.operators import fusion, retrieval
from lodeworks.operators.text import token_estimate
from lodeworks.plans.registry import register
from lodeworks.session import ship_package, table

K = 10
_DOT = "list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))"
_VECTORS = f"""
WITH v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
q AS (SELECT id AS qid, e FROM v WHERE id % 50 = 0),
pairs AS (SELECT q.qid, c.id, c.label, {_DOT} AS dot, sqrt(list_sum(list_transform(q.e, lambda x: x * x))) AS nq,
  sqrt(list_sum(list_transform(c.e, lambda x: x * x))) AS nc,
  list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS sq,
  list_sum(list_transform(list_zip(q.e, c.e), lambda p: abs(p[1] - p[2]))) AS l1
  FROM q CROSS JOIN v c)"""


def _topk_sql(score: str, order: str, where: str = "true", k: int = K) -> str:
    return f"""{_VECTORS},
s AS (SELECT qid, id, round({score}, 6) + 0.0 AS score FROM pairs),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score {order}, id) AS INTEGER) AS rank FROM s WHERE {where})
SELECT qid, rank, id, score FROM r WHERE rank <= {k}"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _topk(spark: SparkSession, sf_dir: str, metric: str, **more) -> DataFrame:
    corpus = _vectors(spark, sf_dir)
    return retrieval.dense_topk_rows(corpus.where("id % 50 = 0"), corpus, more.pop("k", K), metric, **more)


@register("dense_topk_cosine", _topk_sql("dot / (nq * nc)", "DESC"))
def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, "cosine")


@register("dense_topk_l2", _topk_sql("sqrt(sq)", "ASC"))
def dense_topk_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, "l2")


@register("dense_topk_l2_squared", _topk_sql("sq", "ASC"))
def dense_topk_l2_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, "l2_squared")


@register("dense_topk_manhattan", _topk_sql("l1", "ASC"))
def dense_topk_manhattan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, "manhattan")


@register("dense_topk_ip", _topk_sql("dot", "DESC"))
def dense_topk_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, "ip")


@register("cosine_threshold", _topk_sql("1 - dot / (nq * nc)", "ASC", "score < 0.8"))
def cosine_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topk(spark, sf_dir, "cosine_distance", max_distance=0.8)


@register(
    "metric_direction",
    """SELECT m AS metric, CASE WHEN upper(trim(m)) IN ('L2','EUCLID','EUCLIDEAN','MANHATTAN','JACCARD','HAMMING') THEN 'distance'
WHEN upper(trim(m)) IN ('COSINE','IP','INNER_PRODUCT','DOT','DOT_PRODUCT') THEN 'similarity' ELSE 'rank_score' END AS score_kind
FROM (SELECT DISTINCT unnest(['l2', ' cosine', 'IP', 'BM25', 'Hamming', r_name]) AS m FROM region)""",
)
def metric_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in ("l2", " cosine", "IP", "BM25", "Hamming")), "r_name")
    return table(spark, sf_dir, "region").select(F.explode(names).alias("metric")).distinct().select("metric", retrieval.score_kind(F.col("metric")).alias("score_kind"))


@register(
    "multi_collection_search",
    f"""{_VECTORS},
r AS (SELECT qid, id, label, round(dot / (nq * nc), 6) AS score FROM pairs WHERE label IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY score DESC, id) AS rank FROM r)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY label, rank) AS INTEGER) AS pos, label, CAST(rank AS INTEGER) AS rank, id, score FROM t WHERE rank <= 3""",
)
def multi_collection_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _vectors(spark, sf_dir).where("label is not null")
    hits = retrieval.dense_topk_rows(_vectors(spark, sf_dir).where("id % 50 = 0"), corpus, 3, by="label")
    return retrieval.per_collection(hits.drop("rank"), "label", "label", 3).select("qid", "pos", "label", "rank", "id", "score")


_TERMS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"


@register(
    "bm25_topk",
    f"""WITH d AS (SELECT doc_id AS id, {_TERMS} AS t FROM documents), c AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT id, len(t) AS l, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM d) GROUP BY id, len(t), term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id AS qid, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT q.qid, p.id, round(sum(ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.l / c.avgdl))), 6) AS score
  FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN c GROUP BY q.qid, p.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
SELECT qid, rank, id, score FROM r WHERE rank <= 10""",
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.bm25_topk(docs, queries, K)


def _two_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _topk(spark, sf_dir, "l2", k=20), _topk(spark, sf_dir, "ip", k=20)


_TWO = f"""{_VECTORS},
d0 AS (SELECT qid, id, round(sqrt(sq), 6) + 0.0 AS score FROM pairs), s0 AS (SELECT qid, id, round(dot, 6) + 0.0 AS score FROM pairs),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM d0) WHERE rank <= 20),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s0) WHERE rank <= 20)"""


@register(
    "rrf_fusion",
    f"""{_TWO}, f AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM (SELECT qid, id, rank FROM d UNION ALL SELECT qid, id, rank FROM s) GROUP BY qid, id)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM f""",
)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = _two_lists(spark, sf_dir)
    return fusion.plain_rrf(d.select("qid", "rank", "id").unionByName(s.select("qid", "rank", "id")))


@register(
    "weighted_rrf_anchored",
    f"""{_TWO}, j AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.id, s.id) AS id, d.rank AS dense_rank, s.rank AS sparse_rank,
round(coalesce(1.5 / (5 + d.rank), 0) + coalesce(1.0 / (5 + s.rank), 0), 9) AS score FROM d FULL JOIN s ON d.qid = s.qid AND d.id = s.id)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN dense_rank <= 2 THEN dense_rank END NULLS LAST, score DESC, coalesce(dense_rank, 21), coalesce(sparse_rank, 21), id) AS INTEGER) AS rank,
id, score, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM j""",
)
def weighted_rrf_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = _two_lists(spark, sf_dir)
    return fusion.weighted_rrf(d, s, anchors=2)


@register(
    "weighted_score_fusion",
    f"""{_TWO}, dn AS (SELECT qid, id, CASE WHEN max(-score) OVER w = min(-score) OVER w THEN 1.0 ELSE (-score - min(-score) OVER w) / (max(-score) OVER w - min(-score) OVER w) END AS x FROM d WINDOW w AS (PARTITION BY qid)),
sn AS (SELECT qid, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS y FROM s WINDOW w AS (PARTITION BY qid)),
j AS (SELECT coalesce(dn.qid, sn.qid) AS qid, coalesce(dn.id, sn.id) AS id, round(0.6 * coalesce(x, 0) + 0.4 * coalesce(y, 0), 9) AS score FROM dn FULL JOIN sn ON dn.qid = sn.qid AND dn.id = sn.id)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM j""",
)
def weighted_score_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = _two_lists(spark, sf_dir)
    return fusion.weighted_scores(d.withColumn("score", -F.col("score")), s, 0.6, 0.4)


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three result groups for each question: the top forty of three query vectors that follow one another."""
    corpus = _vectors(spark, sf_dir)
    hits = retrieval.dense_topk_rows(corpus.where("id % 50 = 0"), corpus, 40, "l2")
    return hits.select(F.floor(F.col("qid") / 150).alias("qid"), (F.floor(F.col("qid") / 50) % 3).cast("int").alias("grp"), "rank", "id")


_GROUPS = f"""{_VECTORS}, g0 AS (SELECT qid, id, round(sqrt(sq), 6) + 0.0 AS score FROM pairs),
g AS (SELECT CAST(qid // 150 AS BIGINT) AS qid, CAST(qid // 50 % 3 AS INTEGER) AS grp, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, id) AS rank FROM g0) WHERE rank <= 40)"""


@register(
    "round_robin_merge",
    f"""{_GROUPS}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY rank, grp) AS n FROM g) WHERE n = 1)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank, grp) AS INTEGER) AS pos, id FROM o""",
)
def round_robin_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.round_robin(_groups(spark, sf_dir))


_CROSS = f"""{_GROUPS},
a0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY grp, rank) AS n FROM g WHERE rank <= 1) WHERE n = 1),
a AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY grp, rank) AS anchor FROM a0),
sc AS (SELECT qid, id, round(sum(1.0 / (5 + rank)), 9) AS score, min(grp) AS fg, arg_min(rank, grp) AS fr FROM g GROUP BY qid, id),
m AS (SELECT sc.*, a.anchor, row_number() OVER (PARTITION BY sc.qid ORDER BY a.anchor NULLS LAST, score DESC, fr, fg, sc.id) AS pos FROM sc LEFT JOIN a ON sc.qid = a.qid AND sc.id = a.id)"""


@register("cross_query_rrf_merge", f"{_CROSS} SELECT qid, CAST(pos AS INTEGER) AS pos, id, score, anchor IS NOT NULL AS anchored FROM m")
def cross_query_rrf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.cross_query_rrf(_groups(spark, sf_dir))


def _with_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = fusion.cross_query_rrf(_groups(spark, sf_dir))
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("doc"))
    return merged.join(labels, "id")


@register(
    "doc_diversify",
    f"""{_CROSS}, l AS (SELECT m.qid, m.pos, m.id, CAST(e.label AS BIGINT) AS doc FROM m JOIN embeddings e ON m.id = e.vec_id),
t AS (SELECT *, CASE WHEN pos <= 3 THEN 0 WHEN row_number() OVER (PARTITION BY qid, doc ORDER BY pos) = 1 THEN 1 ELSE 2 END AS turn FROM l),
n AS (SELECT qid, id, doc, CAST(row_number() OVER (PARTITION BY qid ORDER BY turn, pos) AS INTEGER) AS pos FROM t)
SELECT qid, pos, id, doc FROM n WHERE pos <= 20""",
)
def doc_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.diversify_documents(_with_documents(spark, sf_dir), 20, 3)


@register("near_tie_diversify")
def near_tie_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _topk(spark, sf_dir, "cosine", k=30)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("doc"))
    return fusion.diversify_near_ties(hits.join(labels, "id"), 0.1)


@register(
    "anchor_guard",
    f"""{_CROSS}, sel AS (SELECT qid, id, pos FROM m WHERE pos > 2 AND pos <= 12),
h AS (SELECT qid, id, min(grp) AS grp FROM g WHERE rank = 1 GROUP BY qid, id), miss AS (SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.qid = h.qid AND sel.id = h.id)),
u AS (SELECT qid, 0 AS late, pos AS nth, id FROM sel UNION ALL SELECT qid, 1, grp, id FROM miss)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY late, nth) AS INTEGER) AS pos, id FROM u""",
)
def anchor_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = fusion.cross_query_rrf(_groups(spark, sf_dir)).where("pos > 2 and pos <= 12").select("qid", "pos", "id")
    return fusion.guard_anchors(merged, _groups(spark, sf_dir))


@register(
    "first_wins_text_dedup",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
)
def first_wins_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("same"))
    return fusion.first_wins(docs, F.col("same"), [], ["doc_id"]).select("doc_id")


@register(
    "identity_first_wins",
    """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(source), lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""",
)
def identity_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    key = F.sha2(fusion.identity("source_chunk", F.col("text"), F.col("source"), none, none), 256)
    return fusion.first_wins(table(spark, sf_dir, "documents").withColumn("key", key), F.col("key"), [], ["doc_id"]).select("doc_id")


@register(
    "evidence_budget",
    """WITH h AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents),
t AS (SELECT *, least(CAST(ceil(length(text) / 3.0) AS BIGINT), 1200) AS tokens FROM h WHERE pos <= 8),
b AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT source AS qid, CAST(pos AS INTEGER) AS pos, doc_id, CAST(tokens AS BIGINT) AS tokens, CAST(least(tokens, 5000 - before) AS BIGINT) AS granted FROM b WHERE before < 5000""",
)
def evidence_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("qid"), "doc_id", "text")
    # the first eight of each source are ranked within the scan's partial window limit
    hits = docs.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("doc_id"))).where("pos <= 8")
    tokens = F.ceil(F.length("text") / 3.0).cast("long")
    return fusion.evidence_budget(hits, tokens, 8, 1200, 5000).select("qid", "pos", "doc_id", F.col("tokens").cast("long"), F.col("granted").cast("long"))


@register(
    "token_estimate",
    """SELECT conv_id, CAST(2 + sum(6 + cjk + CAST(ceil(other / 3.0) AS BIGINT) + CAST(ceil(length(role) / 3.0) AS BIGINT)) AS BIGINT) AS tokens FROM (
SELECT conv_id, role, length(regexp_replace(coalesce(text, ''), '[^一-鿿]', '', 'g')) AS cjk, length(regexp_replace(coalesce(text, ''), '[一-鿿]', '', 'g')) AS other FROM conversations) GROUP BY conv_id""",
)
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg((F.lit(2) + F.sum(F.lit(6) + token_estimate(F.col("text")) + token_estimate(F.col("role")))).cast("long").alias("tokens"))


@register(
    "evidence_source_count",
    f"""{_VECTORS}, r AS (SELECT qid, label, id, row_number() OVER (PARTITION BY qid ORDER BY round(dot / (nq * nc), 6) DESC, id) AS rank FROM pairs)
SELECT qid, count(DISTINCT label) AS n_sources FROM r WHERE rank <= 10 GROUP BY qid""",
)
def evidence_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return retrieval.evidence_source_count(_topk(spark, sf_dir, "cosine").join(labels, "id"), ["label"])
