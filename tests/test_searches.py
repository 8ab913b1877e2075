"""Rounds search once, and a search numbers its queries without losing one."""

from pyspark.sql import functions as F

from lodeworks.operators import loops, retrieval
from tests.test_rounds_and_commits import DOCS, word_search


def test_a_round_is_searched_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    mark, plain = F.udf(counted, "long").asNondeterministic(), word_search(spark, DOCS)
    questions = spark.createDataFrame([(1,)], "qid long")
    proposals = spark.createDataFrame([(1, 1, "w1", False)], "qid long, round int, query string, enough boolean")
    steps, evidence = loops.chain_retrieval(questions, proposals, lambda asked: plain(asked).where(mark("id") >= 0))
    n = sum("w1" in t.split() for _, t, _ in DOCS)
    assert steps.count() == 2 and evidence.count() == n > 0
    assert seen.value == n


def test_search_ranks_every_query(spark):
    impacts = spark.range(400).selectExpr("concat('w', id % 2) as term", "id", "1.0 / (1 + id) as s")
    asked = spark.range(100).selectExpr("id as qid", "concat('query ', id) as query", "explode(array('w0', 'w1')) as term")
    found = retrieval.bm25_search(impacts, asked, ["qid", "query"], 2)
    assert sorted(tuple(r) for r in found.collect()) == sorted((q, f"query {q}", r, r - 1, round(1 / r, 6)) for q in range(100) for r in (1, 2))
