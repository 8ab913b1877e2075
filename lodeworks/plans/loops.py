"""Retrieval in rounds over ``benchmark`` and ``documents``, with recursive SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.operators import loops, planning, retrieval
from lodeworks.plans.registry import register
from lodeworks.plans.retrieval import _TERMS
from lodeworks.session import settle, table

_HITS, _WIDTH, _LONG = 3, 4, 250


def _slices(spark: SparkSession, sf_dir: str, rounds: int, each: int) -> DataFrame:
    """``qid, round, query``: a planner's stand-in, the words of each item four at a time, ``each`` groups a round."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), retrieval.terms(F.coalesce("text", F.lit(""))).alias("t"))
    groups = words.select("qid", "t", F.explode(F.sequence(F.lit(0), F.lit(rounds * each - 1))).alias("n"))
    return groups.select("qid", "t", "n", (F.floor(F.col("n") / each) + 1).cast("int").alias("round"))


def _cut(n: Column) -> Column:
    return F.array_join(F.slice("t", n * _WIDTH + 1, F.lit(_WIDTH)), " ")


def _searcher(spark: SparkSession, sf_dir: str, proposals: DataFrame) -> loops.Search:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    vocabulary = proposals.select(F.explode(retrieval.terms(F.coalesce("query", F.lit("")))).alias("term"))
    impacts = settle(retrieval.bm25_impacts(docs, vocabulary), "loop-index")  # once, for every round

    def search(asked: DataFrame) -> DataFrame:
        keys = ["qid", "query"]
        hits = retrieval.bm25_search(impacts, retrieval.query_terms(asked.withColumn("text", F.col("query")), keys), keys, _HITS)
        return hits.join(docs.select("id", "source"), "id").select(*keys, "rank", "id", "source")

    return search


_INDEX = f"""d AS (SELECT doc_id AS id, source, {_TERMS} AS t FROM documents), c AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
p AS (SELECT id, len(t) AS l, term, count(*) AS tf FROM (SELECT id, t, unnest(t) AS term FROM d) GROUP BY id, len(t), term),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT item_id AS qid, {_TERMS} AS t, length(text) AS chars FROM benchmark)"""

_SEARCH = f"""terms AS (SELECT DISTINCT qid, round, core, unnest({_TERMS.replace("coalesce(text, '')", "core")}) AS term FROM asked),
scored AS (SELECT q.qid, q.round, q.core, p.id, round(sum(ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.l / c.avgdl))), 6) AS score
  FROM terms q JOIN p USING (term) JOIN f USING (term) CROSS JOIN c GROUP BY q.qid, q.round, q.core, p.id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, round, core ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {_HITS})"""


@register(
    "iterative_retrieval",
    f"""WITH RECURSIVE {_INDEX},
props AS (SELECT qid, 1 + n // 2 AS round, array_to_string(t[(CASE WHEN qid % 3 = 0 AND n // 2 = 1 THEN n - 2 ELSE n END) * {_WIDTH} + 1 : (CASE WHEN qid % 3 = 0 AND n // 2 = 1 THEN n - 2 ELSE n END) * {_WIDTH} + {_WIDTH}], ' ') AS core
  FROM (SELECT qid, t, unnest(range(0, 6)) AS n FROM w)),
asked AS (SELECT qid, core, min(round) AS round FROM props WHERE core <> '' GROUP BY qid, core), {_SEARCH},
merged AS (SELECT qid, round, id, row_number() OVER (PARTITION BY qid, round ORDER BY min(rank), id) AS place FROM hits GROUP BY qid, round, id),
r AS (SELECT g.qid, g.round, coalesce(a.nq, 0) AS nq, coalesce(m.ids, []) AS ids, coalesce(m.sources, []) AS sources
  FROM (SELECT qid, unnest([1, 2, 3]) AS round FROM w) g LEFT JOIN (SELECT qid, round, count(*) AS nq FROM asked GROUP BY ALL) a ON a.qid = g.qid AND a.round = g.round
  LEFT JOIN (SELECT qid, round, list(id) AS ids, list(source) FILTER (source IS NOT NULL) AS sources FROM merged JOIN d USING (id) WHERE place <= 10 GROUP BY qid, round) m ON m.qid = g.qid AND m.round = g.round),
s AS (SELECT qid, 0 AS round, CAST(0 AS BIGINT) AS nq, CAST(0 AS BIGINT) AS last, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS sources, CAST(NULL AS VARCHAR) AS stop, chars > {_LONG} AS broad FROM w
  UNION ALL
  SELECT qid, round, nq, last, ids, sources, CASE WHEN last = 0 THEN 'no_new_query' WHEN round = 1 AND NOT broad AND qid % 11 <> 0 AND len(ids) >= 4 AND len(sources) >= 2 THEN 'enough_evidence' WHEN round = 3 THEN 'max_rounds' END, broad
  FROM (SELECT s.qid, r.round, s.nq + r.nq AS nq, r.nq AS last, list_distinct(list_concat(s.ids, r.ids)) AS ids, list_distinct(list_concat(s.sources, r.sources)) AS sources, s.broad
    FROM s JOIN r ON r.qid = s.qid AND r.round = s.round + 1 WHERE s.stop IS NULL))
SELECT qid, CAST(round - CASE WHEN last = 0 THEN 1 ELSE 0 END AS INTEGER) AS rounds, CAST(nq AS INTEGER) AS n_queries, CAST(len(ids) AS INTEGER) AS n_items, CAST(len(sources) AS INTEGER) AS n_sources, stop AS stop_reason FROM s WHERE stop IS NOT NULL""",
)
def iterative_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of ``benchmark`` in rounds of two queries; every third plans its first queries again, long ones are broad, every eleventh is risky."""
    n = F.col("n")
    proposals = settle(_slices(spark, sf_dir, 3, 2).select("qid", "round", _cut(F.when((F.col("qid") % 3 == 0) & (F.col("round") == 2), n - 2).otherwise(n)).alias("query")), "loop-proposals")
    text = F.col("text")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), (planning.comprehensive(text) | (F.length(text) > _LONG)).alias("comprehensive"), (F.col("item_id") % 11 == 0).alias("high_risk"))
    return loops.iterative_retrieval(questions, proposals, _searcher(spark, sf_dir, proposals))[0]


@register(
    "chain_retrieval",
    f"""WITH RECURSIVE {_INDEX},
props AS (SELECT qid, 1 + n AS round, array_to_string(t[(CASE WHEN qid % 4 = 1 AND n = 2 THEN 0 ELSE n END) * {_WIDTH} + 1 : (CASE WHEN qid % 4 = 1 AND n = 2 THEN 0 ELSE n END) * {_WIDTH} + {_WIDTH}], ' ') AS core FROM (SELECT qid, t, unnest(range(0, 4)) AS n FROM w)),
asked AS (SELECT DISTINCT qid, round, core FROM props WHERE core <> ''), {_SEARCH},
r AS (SELECT p.qid, p.round, p.core, coalesce(list(DISTINCT h.id) FILTER (h.id IS NOT NULL), []) AS ids, bool_or(coalesce(e.again, false)) AS again
  FROM props p LEFT JOIN hits h ON h.qid = p.qid AND h.round = p.round LEFT JOIN (SELECT a.qid, a.round, true AS again FROM props a JOIN props b ON a.qid = b.qid AND b.round < a.round AND a.core = b.core AND a.core <> '') e ON e.qid = p.qid AND e.round = p.round
  GROUP BY p.qid, p.round, p.core),
s AS (SELECT qid, 0 AS step, '' AS core, CAST([] AS BIGINT[]) AS ids, CAST(0 AS BIGINT) AS had, false AS trusted, CAST(NULL AS VARCHAR) AS gate, CAST(NULL AS VARCHAR) AS stop FROM w
  UNION ALL
  SELECT qid, step, core, ids, had, trusted, gate, coalesce(refusal, CASE WHEN gate = 'model_has_enough_verified_evidence' THEN 'enough_verified_evidence' END, CASE WHEN step = 4 THEN 'max_iterations' END)
  FROM (SELECT *, CASE WHEN refusal IS NOT NULL THEN NULL WHEN len(ids) < 3 THEN 'insufficient_unique_evidence' WHEN qid % 2 = 0 THEN 'model_has_enough_verified_evidence' ELSE 'model_requests_more_verified_evidence' END AS gate
    FROM (SELECT s.qid, r.round AS step, r.core, len(s.ids) AS had, CASE WHEN r.core = '' THEN 'empty_followup_query' WHEN r.again THEN 'duplicate_followup_query' END AS refusal,
      CASE WHEN r.core = '' OR r.again THEN s.ids ELSE list_distinct(list_concat(s.ids, r.ids)) END AS ids, NOT (r.core = '' OR r.again) AND len(r.ids) > 0 AS trusted
      FROM s JOIN r ON r.qid = s.qid AND r.round = s.step + 1 WHERE s.stop IS NULL)))
SELECT qid, CAST(step AS INTEGER) AS step, core AS query, trusted, CAST(len(ids) - had AS INTEGER) AS new_items, CAST(len(ids) AS INTEGER) AS n_items, round(least(1.0, len(ids) / 3), 3) AS confidence, gate, stop AS stop_reason FROM s WHERE step > 0""",
)
def chain_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of ``benchmark`` step by step; every fourth repeats its first query in step 3, every second has enough when its evidence suffices."""
    n = F.col("n")
    proposals = settle(_slices(spark, sf_dir, 4, 1).select("qid", "round", _cut(F.when((F.col("qid") % 4 == 1) & (n == 2), 0).otherwise(n)).alias("query"), (F.col("qid") % 2 == 0).alias("enough")), "chain-proposals")
    questions = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    return loops.chain_retrieval(questions, proposals, _searcher(spark, sf_dir, proposals))[0]
