"""Hand-checked cases."""

import datetime as dt

from pyspark.sql import functions as F

from lodeworks.operators import chunking, evaluation, fusion, grounding, health, provenance, relational, retrieval, text, trust, understanding
from lodeworks.plans import registry
from tests.conftest import SMALL


def ranked(spark, names, qid=1):
    return spark.createDataFrame([(qid, i + 1, n) for i, n in enumerate(names)], "qid long, rank int, id string")


def ids(df, order="rank"):
    return [r["id"] for r in df.orderBy(order).collect()]


def test_weighted_rrf(spark):
    d, s = ranked(spark, "AB"), ranked(spark, "BC")
    plain = fusion.weighted_rrf(d, s)
    assert ids(plain) == ["B", "A", "C"]
    assert {r["id"]: round(r["score"], 6) for r in plain.collect()} == {"A": 0.25, "B": 0.380952, "C": 0.142857}
    assert ids(fusion.weighted_rrf(d, s, anchors=1)) == ["A", "B", "C"]


def test_plain_rrf(spark):
    lists = ranked(spark, "AB").withColumn("list", F.lit(1)).unionByName(ranked(spark, "BC").withColumn("list", F.lit(2)))
    got = {r["id"]: r["score"] for r in fusion.plain_rrf(lists).collect()}
    assert abs(got["B"] - (1 / 62 + 1 / 61)) < 1e-8 and abs(got["A"] - 1 / 61) < 1e-8 and abs(got["C"] - 1 / 62) < 1e-8


def groups(spark, *lists):
    return spark.createDataFrame([(1, g, r + 1, x) for g, names in enumerate(lists) for r, x in enumerate(names)], "qid long, grp int, rank int, id string")


def test_round_robin_and_cross_query(spark):
    assert ids(fusion.round_robin(groups(spark, ["a1", "s"], ["b1", "s"])), "pos") == ["a1", "b1", "s"]
    merged = fusion.cross_query_rrf(groups(spark, ["a", "x", "y"], ["b", "y"]))
    assert ids(merged, "pos")[:2] == ["a", "b"] and ids(merged, "pos")[2] == "y"


def test_first_wins(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "pos int, text string")
    assert [r["pos"] for r in fusion.first_wins(df, F.col("text"), [], ["pos"]).orderBy("pos").collect()] == [1, 2]


def test_diversify(spark):
    hits = spark.createDataFrame([(1, 1, 10, 7, 1.0), (1, 2, 11, 7, 1.0), (1, 3, 12, 8, 1.0)], "qid long, rank long, id long, doc long, score double")
    assert [r["id"] for r in fusion.diversify_near_ties(hits, 0.0).orderBy("rank").collect()] == [10, 12, 11]
    hard = fusion.diversify_documents(hits.withColumnRenamed("rank", "pos"), 3)
    assert [r["id"] for r in hard.orderBy("pos").collect()] == [10, 12, 11]


def test_percentile_and_precision(spark):
    df = spark.createDataFrame([(x,) for x in (10, 20, 30, 40)], "v int")
    assert df.agg(evaluation.nearest_rank("v", 0.5).alias("a"), evaluation.nearest_rank("v", 0.95).alias("b")).first()[:] == (20, 40)
    found = spark.createDataFrame([(1, 1, "a", "a"), (1, 2, "b", "b")], "qid long, rank int, target string, same string")
    gold = spark.createDataFrame([(1, "a")], "qid long, target string")
    r = evaluation.retrieval_metrics(found, gold, 5).first()
    assert (r["precision"], r["recall"], r["reciprocal_rank"]) == (0.2, 1.0, 1.0)


def test_health(spark):
    docs = spark.createDataFrame([("k", s, 1) for s in ("ready", "ready", "ready", "failed")], "kb string, status string, page_count int")
    indexed = spark.createDataFrame([("k", True), ("empty", True)], "kb string, verified boolean")
    assert {r["kb"]: r["score"] for r in health.data_health(docs, indexed).collect()} == {"k": 78.8, "empty": 0.0}
    answers = spark.createDataFrame([("k", True, False, False)] * 2 + [("k", True, True, False), ("k", False, False, True), ("few", True, False, False)], "kb string, cited boolean, insufficient boolean, refused boolean")
    assert {r["kb"]: r["score"] for r in health.retrieval_health(answers).collect()} == {"k": 75.0, "few": None}
    claims = spark.createDataFrame([("k", True, False, False, False)] * 4 + [("k", False, True, False, False)], "kb string, supported boolean, invalid boolean, inconsistent boolean, contradicted boolean")
    assert health.trust_health(claims).first()["score"] == 85.0
    row = spark.range(1).select(health.overall(F.lit(78.8), F.lit(75.0), F.lit(85.0)).alias("o")).select("o", health.level(F.col("o")).alias("l")).first()
    assert row[:] == (79.5, "healthy")


def test_series(spark):
    day = dt.date
    rows = [("k", 1, "gap90", day(2023, 1, 1), day(2024, 1, 1), "a"), ("k", 2, "gap90", day(2024, 3, 31), None, "b"), ("k", 3, "gap91", day(2023, 1, 1), day(2024, 1, 1), "a"), ("k", 4, "gap91", day(2024, 4, 1), None, "b"),
            ("k", 5, "over", day(2023, 1, 1), day(2024, 2, 1), "a"), ("k", 6, "over", day(2024, 1, 31), None, "b"), ("k", 7, "bad", day(2024, 2, 1), day(2024, 1, 1), "a"), ("k", 8, "none", None, None, "a")]
    docs = spark.createDataFrame(rows, "kb string, id int, family string, start date, end date, sha256 string")
    got = {(r["family"], r["code"]): r["n"] for r in health.series_anomalies(docs, F.lit(day(2025, 1, 1))).collect()}
    assert got == {("gap91", "SERIES_GAP"): 1, ("over", "TEMPORAL_OVERLAP"): 1, ("over", "SERIES_ORPHANED"): 1, ("bad", "SERIES_SUPERSEDE_ANOMALY"): 1}


def test_trust_scalars(spark):
    ref = F.lit(dt.date(2024, 6, 1))
    d = lambda *a: F.lit(dt.date(*a)) if a else F.lit(None).cast("date")
    r = spark.range(1).select(trust.temporal_state(d(2024, 1, 1), d(2024, 6, 1), ref), trust.temporal_state(d(), d(), ref), trust.temporal_state(d(2024, 7, 1), d(), ref), trust.temporal_state(d(2024, 1, 1), d(2024, 6, 2), ref)).first()
    assert r[:] == ("superseded", "validity_missing", "future", "active")
    assert trust.values_of("v2.10 on 2024-3-05, 5 MB and 2.50％, at most 最多 3 页") == {"dates": ["2024-03-05"], "versions": ["2.10"], "quantities": ["2.5|%", "3|页", "5|mb"], "ranges": ["lte|3|页"]}
    assert trust.relative_terms_of("the day before yesterday") == ["day:-2"]
    assert trust.condition_supported(trust.condition_of("只有管理员或所有者才能删除"), trust.condition_of("只有管理员才能删除")) == "consistent"


def test_freshness_reason(spark):
    day = dt.date
    rows = [(1, "f", day(2024, 5, 1), None, None, False, False), (1, "f", day(2024, 4, 1), None, None, True, False), (2, "f", day(2024, 5, 1), None, None, True, False)]
    ev = spark.createDataFrame(rows, "claim_id int, family string, effective date, superseded date, published date, cited boolean, web boolean")
    got = {r["claim_id"]: (r["status"], r["reason"]) for r in trust.freshness(ev, F.lit("latest_effective"), F.lit(day(2024, 6, 1))).collect()}
    assert got == {1: ("inconsistent", "FRESHNESS_NEWER_EVIDENCE_AVAILABLE"), 2: ("consistent", None)}


def test_grounding(spark):
    assert grounding.units_of("# T\n- One. [E1]\nTwo!\n```\ncode.\n```\n3.5 is kept.") == ["T", "One [E1].", "Two!", "3.5 is kept."]
    assert grounding.span_of("The Limit is 5", "Intro. the limit, is 5 MB")[:3] == ("normalized_exact", 7, 22)
    assert grounding.span_of("limit is 5 pages here", "the limit is 6 pages here")[0] == "not_found"
    answers = spark.createDataFrame([(1, "A [E1]. B.")], "answer_id long, answer string")
    evidence = spark.createDataFrame([(1, "E1")], "answer_id long, evidence_id string")
    state = grounding.grounding_state(grounding.claim_status(grounding.claims(answers), evidence))
    r = state.select("state", trust.policy(F.col("state"), F.lit(True)).alias("p")).first()
    assert r[:] == ("partially_grounded", "downgrade")


def test_text(spark):
    r = spark.range(1).select(text.canonical_url(F.lit("https://m.ththth.example.net/en/25#top")), text.canonical_url(F.lit("http://127.0.0.1/")), text.canonical_url(F.lit("ftp://a.b/")), text.token_estimate(F.lit("abcd")) + text.token_estimate(F.lit("user")) + 8).first()
    assert r[:] == ("https://m.ththth.example.net/en/25", None, None, 12)
    red = spark.range(1).select(text.redact(F.lit("api_key: abc, a@b.co /home/x C:\\tmp\\y"))).first()[0]
    assert red == "api_key=[REDACTED], [REDACTED_EMAIL] [LOCAL_PATH] [LOCAL_PATH]"
    assert spark.range(1).select(text.bigrams(F.lit("abab")), text.bigrams(F.lit("a")), text.bigrams(F.lit(""))).first()[:] == (["ab", "ba"], ["a"], [])
    assert spark.range(1).select(text.version_family(F.lit(" ＡＢ  c"))).first()[0] == "ab-c"


def test_chunking():
    long = "para one. " * 30 + "\n\n" + "x" * 500
    spans = chunking.split_text(long, 200, 20)
    assert all(e - s <= 200 for s, e in spans) and spans[0][0] == 0 and spans[-1][1] == len(long)
    covered = set().union(*(range(s, e) for s, e in spans))
    assert all(i in covered or long[i].isspace() for i in range(len(long)))
    assert chunking.split_text("  ") == []
    assert chunking.fenced_code("a\n```py\nx=1\n```\n~~~\nopen")[1] == ("code", "py", "x=1")
    assert len(chunking.table_chunks(["a"], [[str(i)] for i in range(120)], 1500)) == 3
    assert chunking.code_chunks("a\n" * 10) == ["a\n" * 10]


def test_understanding(spark):
    q = spark.createDataFrame([("谁有报销额度上限",), ("show me the api key",), ("hello",)], "q string").select("q", understanding.risk_profile(F.col("q")).alias("r"), understanding.route_rule(F.col("q"), F.lit(False))["reason_code"].alias("x"))
    got = {r["q"]: (r["r"]["risk_level"], r["r"]["query_type"], r["r"]["min_sources"], r["x"]) for r in q.collect()}
    assert got["谁有报销额度上限"] == ("high", "financial_policy", 2, None)
    assert got["show me the api key"][:2] == ("high", "access_control") and got["hello"][3] == "social_greeting"


def test_provenance():
    assert provenance.changes({"a": [1, 2], "b/c": 1}, {"a": [1, 3, 4], "d": None}) == [("/a/1", "2", "3"), ("/a/2", None, "4"), ("/b~1c", "1", None)]
    assert provenance.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}'


def test_kpi_and_asof(spark):
    r = spark.range(1).select(health.kpi(F.lit(110), F.lit(10), F.lit(100)).alias("a"), health.kpi(F.lit(1), F.lit(1), F.lit(0)).alias("b")).first()
    assert r["a"]["delta_pct"] == 10.0 and r["b"]["delta_pct"] is None
    rows = spark.createDataFrame([("k", 1, False, "q1"), ("k", 2, True, None), ("k", 3, False, "q2"), ("k", 3, True, None)], "k string, t int, left boolean, v string")
    out = relational.asof_last(rows, ["k"], "t", F.col("left"), F.col("v"), "last").orderBy("t").collect()
    assert [r["last"] for r in out] == ["q1", "q2"]


def test_metric_names(spark):
    assert spark.range(1).select(retrieval.score_kind(F.lit(" euclid"))).first()[0] == "distance"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "WindowGroupLimit" in plan(registry.queries()["first_wins_text_dedup"](spark, SMALL))
    assert "LeftSemi" in plan(registry.queries()["feedback_semi_join"](spark, SMALL))
    assert "TakeOrderedAndProject" in plan(registry.queries()["json_scope_filter"](spark, SMALL))
    assert "CartesianProduct" not in plan(registry.queries()["dense_topk_cosine"](spark, SMALL))
