"""Definitions, conditions, literals, neighbours, gates, provenance, fallback."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.operators import ann, conditions, definitions, gates, literals, provenance
from lodeworks.plans import registry
from lodeworks.streaming import routing

DEFINITION = "DeepSearcher 是一个基于 RAG 的文档问答项目，解决的是回答缺少依据的问题。"


def test_questions_for_definitions_and_their_subjects(spark):
    asked = {
        "什么是DeepSearcher": (True, "deepsearcher"), "DeepSearcher 是什么？": (True, "deepsearcher是什么"), "DeepSearcher 是什么": (True, "deepsearcher"), "What is  Spark SQL?": (True, "sparksql"),
        "define a_b.c": (True, "a_b.c"), "How does it work": (False, "howdoesitwork"), "": (False, ""), None: (False, ""),
    }
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    got = {r.q: (r.d, r.s) for r in df.select("q", definitions.asks_definition(F.col("q")).alias("d"), definitions.subject(F.col("q")).alias("s")).collect()}
    assert got == asked


def test_definition_plans(spark):
    docs = spark.createDataFrame([(1, "DeepSearcher"), (2, DEFINITION), (3, "文档切分成片段。"), (4, "# 1\n- Spark SQL is a module;\nmore text. No end\n"), (5, None), (6, "Spark sql refers to x!"), (7, "spark SQL, is it?")], "id long, text string")
    questions = spark.createDataFrame([(1, "什么是DeepSearcher"), (2, "What is Spark SQL?"), (3, "what is nothing"), (4, "tell me"), (5, None)], "qid long, question string")
    built = definitions.index(docs)
    got = {r.qid: (r.query_class, r.decision, r.subject, r.primary, r.reason) for r in definitions.plans(questions, built).collect()}
    assert got == {
        1: ("concept_definition", "definition_first", "deepsearcher", [2], None), 2: ("concept_definition", "definition_first", "sparksql", [4, 6], None),
        3: ("concept_definition", "fallback_default", "nothing", [], "definition_evidence_not_found"), 4: ("other", "default", None, [], None), 5: ("other", "default", None, [], None),
    }
    evidence = spark.createDataFrame([(2, 7, 1), (2, 6, 2), (1, 1, 1), (1, 3, 2)], "qid long, id long, pos int")
    bound = {r.qid: (r.primary, r.reason) for r in definitions.plans(questions, built, evidence).collect()}
    assert bound[2] == ([7, 6], None) and bound[1] == ([], "definition_evidence_outside_snapshot")
    assert {r.decision for r in definitions.plans(questions, definitions.index(docs.limit(0))).collect()} == {"fallback_default", "default"}


def test_answers_begin_with_the_definition(spark):
    rows = [("片段写入。 [E3]", "definition_first"), (f"\n[E2]\n- {DEFINITION} [E2]\nmore", "definition_first"), (f"{DEFINITION} [E3]", "definition_first"), ("any", "default"), (None, "definition_first")]
    df = spark.createDataFrame(rows, "a string, d string")
    gate = definitions.enforced(F.col("a"), F.col("d"), F.lit("deepsearcher"), F.array(F.lit("2")), F.array(F.lit(DEFINITION)))
    got = [tuple(r.g) for r in df.select(gate.alias("g")).collect()]
    assert [g[0] for g in got] == [f"{DEFINITION} [E2]"] * 3 + ["any", f"{DEFINITION} [E2]"]
    assert [g[1] for g in got] == ["canonical_definition"] * 3 + ["not_applicable", "canonical_definition"]
    assert [g[2] for g in got] == [True, False, True, None, True]


@pytest.mark.parametrize(
    ("claim", "evidence", "status", "reason"),
    [
        ("只有管理员才能删除文档", "只有管理员才能删除文档", "consistent", "CONDITIONS_MATCH"),
        ("可以删除文档", "只有管理员才能删除文档", "inconsistent", "CONDITION_OMITTED_OR_CHANGED"),
        ("管理员可以删除文档", "只有管理员才能删除文档", "consistent", "CONDITIONS_MATCH"),
        ("只有管理员或所有者才能删除文档", "只有管理员和所有者才能删除文档", "inconsistent", "CONDITION_RELATION_MISMATCH"),
        ("只有管理员才能删除文档", "只有管理员或所有者才能删除文档", "consistent", "CONDITIONS_MATCH"),
        ("只有未完成审核才能删除文档", "只有审核才能删除文档", "inconsistent", "CONDITION_NEGATED"),
        ("除非管理员否则不得删除文档", "只有管理员才能删除文档", "consistent", "CONDITIONS_MATCH"),
        ("只有管理员和审核员或所有者才能删除文档", "只有管理员才能删除文档", "inconsistent", "CONDITION_OMITTED_OR_CHANGED"),
        ("天气很好", "只有管理员才能删除文档", "not_applicable", None),
        (None, None, "not_applicable", None),
        ("", "", "not_applicable", None),
    ],
)
def test_conditions(spark, claim, evidence, status, reason):
    df = spark.createDataFrame([(claim, evidence)], "claim string, evidence string")
    read = df.select("claim", conditions.restrictions(F.col("claim")).alias("c"), conditions.restrictions(F.col("evidence")).alias("e"))
    r = read.select(conditions.check(F.col("claim"), F.col("c"), F.col("e")).alias("r")).first().r
    assert (r.status, r.reason) == (status, reason) and (status == "inconsistent") == bool(r.missing)


def test_conditions_of_a_text(spark):
    df = spark.createDataFrame([("用户登录后即可查看报告，只有通过审核或获得授权才能下载原文件。只有A才能。",)], "t string")
    got = [(r.relation, r.terms, r.negated, r.conclusion, r.source) for r in df.select(conditions.restrictions(F.col("t")).alias("r")).first().r]
    assert got == [("any", ["审核", "授权"], False, "下载原文件", "required"), ("single", ["用户登录"], False, "查看报告", "stated")]


def scan(text):
    """The top-level spans by hand; None for broken brackets."""
    stack, quote, escaped, out, start = [], None, False, [], 0
    for i, c in enumerate(text):
        if quote:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == quote:
                quote = None
        elif c in "[{":
            if not stack:
                start = i
            stack.append(c)
        elif stack and c in "]}":
            if "[{"["]}".index(c)] != stack.pop():
                return None
            if not stack:
                out.append(text[start : i + 1])
        elif stack and c in "\"'":
            quote = c
    return None if stack or quote else out


def test_literals_equal_a_scan_by_hand(spark):
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("[]{}\"'\\ab, é😀") for _ in range(rnd.randint(0, 14))) for _ in range(600)]

    def value(depth=0):
        kind = rnd.random()
        if depth < 3 and kind < 0.4:
            return [value(depth + 1) for _ in range(rnd.randint(0, 3))]
        if depth < 3 and kind < 0.7:
            return {rnd.choice("xyz\"]"): value(depth + 1) for _ in range(rnd.randint(0, 2))}
        return rnd.choice([1, None, "a ] b", 'q"uote', "back\\slash", "é😀"])

    whole = [[value()] for _ in range(200)]
    texts += [f"Here: {json.dumps(v, ensure_ascii=False)} done" for v in whole] + [f"```json\n{json.dumps(v)}\n```" for v in whole[:50]] + [f"<think>[1]</think>{v!r}" for v in whole[:50]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string")
    got = {r.i: r.x for r in df.select("i", literals.literal(F.col("t")).alias("x")).collect()}
    assert got.pop(-1) is None
    for i in range(600):
        spans = scan(texts[i].strip(" "))
        assert got[i] == (spans[0] if spans and len(spans) == 1 else None), texts[i]
    assert [json.loads(got[600 + i]) for i in range(200)] == whole and [json.loads(got[800 + i]) for i in range(50)] == whole[:50]
    assert [eval(got[850 + i]) for i in range(50)] == whole[:50]  # noqa: S307  reprs made above


def test_breakers_of_a_route_act_together(spark):
    rnd = random.Random(9)
    rows = [(f"r{rnd.randrange(4)}", i, float(rnd.randrange(400)), rnd.sample("abcd", rnd.randint(0, 4)), [rnd.random() < 0.4 for _ in range(rnd.randint(0, 4))]) for i in range(800)]
    rows += [("none", 900, 1.0, None, None), ("none", 901, 2.0, ["a"], [None])]
    got = {r.seq: (r.selected, r.reasons, r.calls) for r in routing.ordered_fallback(spark.createDataFrame(rows, "route string, seq long, t double, providers array<string>, outcomes array<boolean>").repartition(5), 2, 10.0).collect()}
    state: dict = {}
    for route, seq, t, providers, outcomes in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        why, chosen, calls = [], None, 0
        for i, p in enumerate(providers or []):
            bad, since = state.get((route, p), (0, 0.0))
            if bad >= 2 and t - since < 10:
                why.append(f"{p}:circuit_open")
                continue
            calls += 1
            if i < len(outcomes or []) and outcomes[i]:
                state[route, p], chosen = (0, 0.0), p
                break
            state[route, p] = (bad + 1, t if bad + 1 >= 2 else since)
            why.append(f"{p}:error")
        assert got[seq] == (chosen, ";".join(why), calls)


def test_index_finds_nine_of_ten_neighbours(spark):
    got = [r.recall for r in registry.queries()["ann_recall"](spark, "/root/testdata/sf0.1").collect()]
    assert len(got) == 40 and np.mean(got) >= 0.9


def test_index_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    hot = [(i, [1.0, 2.0, 3.0]) for i in range(5000)]  # one list with most rows
    rows = hot + [(5000 + i, rng.normal(size=3).tolist()) for i in range(300)] + [(6000, None), (6001, []), (6002, [0.0] * 3), (6003, [1.0, None, 2.0]), (6004, [float("nan")] * 3), (None, [1.0] * 3), (5000, [3.0, 2.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    book = ann.train(df, lists=4, parts=2, codes=8, sample=400)
    index = ann.build(df, book)
    cells = index.groupBy("list").agg(F.countDistinct("cell").alias("cells"), F.count("*").alias("blocks")).collect()
    assert sum(len(r.ids) // 8 for r in index.collect()) == 5301 and max(r.blocks for r in cells) >= 3
    found = ann.search(df.where("id in (0, 5001, 6002)"), df, index, book, k=5, probes=4, depth=50).collect()
    assert {r.qid for r in found} == {0, 5001} and all(r.score == 1.0 for r in found if r.qid == 0)
    assert [r.id for r in sorted(found, key=lambda r: r["rank"]) if r.qid == 5001][0] == 5001
    assert ann.train(df.limit(0)) is None


def test_gate_finds_each_kind_of_fault(spark):
    details = spark.createDataFrame([("r", "g", 1.0), ("r", "g", 2.0), ("r", "h", None), ("s", "g", 1.0)], "report string, g string, x double")
    bodies = {"r": {"metrics": {"g": {"rows": 2, "x": 1.5}, "h": {"rows": 1, "x": None}}, "name": "one"}, "s": {"metrics": {"g": {"rows": 2, "x": 1.1}, "lost": {"x": 3}}}, "t": {}}
    reports = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()], "report string, body string")
    failed = {(r.report, r.name): r.detail for r in gates.recomputed(reports, details, "g", ["x"]).where("not passed").collect()}
    assert failed == {("s", "recomputed:metrics.g.rows"): "claimed=2.0, actual=1.0", ("s", "recomputed:metrics.g.x"): "claimed=1.1, actual=1.0", ("s", "recomputed:metrics.lost.x"): "claimed=3.0, actual=none"}
    wanted = [("r", "metrics.g.x", "ge", "1.5"), ("r", "metrics.g.x", "gt", "1.5"), ("r", "name", "eq", "one"), ("r", "name", "ge", "1"), ("t", "metrics.g.x", "le", "9"), ("u", "a", "eq", "1"), ("r", "metrics.g.rows", "eq", "2.0")]
    got = [r.passed for r in gates.thresholds(reports, spark.createDataFrame(wanted, "report string, path string, op string, value string")).orderBy("report", "name", "detail").collect()]
    assert sorted(got) == [False] * 4 + [True] * 3


def test_provenance(spark):
    texts = ['{"b":{"token":"x","z":[{"q":1,"a":2}]},"a":1}', '{ "a": 1, "b": {"z": [{"a": 2, "q": 1}], "token": "other"}}', '{"a":1,"b":{"token":"","z":[{"a":2,"q":1}]}}', '{"a":1,"b":{"token":{"$env":"NAME"},"z":[]}}', "no json", None]
    got = [r.d for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", provenance.config_digest(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got[0] == got[1] != got[2] and got[3] and got[4:] == [None, None]
    answers = spark.createDataFrame([(i, f"e{i}") for i in range(5)], "answer_id long, evidence_digest string")
    record = provenance.provenance_record(answer_id=F.col("answer_id"), evidence_digest=F.col("evidence_digest"), execution_scope=F.lit("anything"))
    sound = answers.select("answer_id", record.alias("record"))
    assert json.loads(sound.first().record)["execution_scope"] == "library"
    changed = sound.select("answer_id", F.when(F.col("answer_id") == 1, F.replace("record", F.lit("library"), F.lit("online"))).when(F.col("answer_id") == 2, "{}").when(F.col("answer_id") == 3, None).otherwise(F.col("record")).alias("record"))
    bound = {r.answer_id: r.bound for r in provenance.bound(answers, changed).collect()}
    assert bound == {0: True, 1: False, 2: False, 3: False, 4: True}


def test_finalize_with_questions(spark):
    from lodeworks import api

    answers = spark.createDataFrame(
        [(1, "The limit is five [E1]."), (2, "The limit is five [E2]."), (3, "It was done yesterday [E1]."), (4, "It was done yesterday [E2]."), (5, "Take two pills [E1]."), (6, "Take two pills [E1]."), (7, "Plain fact [E1].")],
        "answer_id long, answer string",
    )
    evidence = spark.createDataFrame(
        [
            (1, "E1", "limit", "f", "2024-01-01", None, None), (1, "E2", "limit", "f", "2023-01-01", None, None), (2, "E1", "limit", "f", "2024-01-01", None, None), (2, "E2", "limit", "f", "2023-01-01", None, None),
            (3, "E1", "On 2024-05-01 it was done", "f", None, None, None), (4, "E2", "done today", "f", None, None, "2024-04-02"), (5, "E1", "Take two pills of it", "f", None, None, None), (6, "E1", "Take two pills of it", "f", None, None, None),
            (7, "E1", "Plain fact.", "f", None, None, None),
        ],
        "answer_id long, evidence_id string, text string, family string, effective string, superseded string, published string",
    )
    day = "2024-05-02"
    questions = spark.createDataFrame(
        [(1, "最新的限制是什么", day), (2, "最新的限制是什么", day), (3, "when", day), (4, "when", day), (5, "我现在应该吃几片药，剂量多少", day), (6, "我现在应该吃几片药，剂量多少", day), (7, "what", day)], "answer_id long, question string, reference string"
    )
    findings = spark.createDataFrame([(5, 1, "entailed", 0.95), (6, 1, "entailed", 0.4)], "answer_id long, claim_index int, verdict string, confidence double")
    got = {r.answer_id: r for r in api.finalize(answers, evidence, findings, questions, least_confidence=0.9).collect()}
    assert {i: r.action for i, r in got.items()} == {1: "allow", 2: "refuse", 3: "allow", 4: "refuse", 5: got[5].action, 6: "refuse", 7: "allow"}
    assert got[3].state == "fully_grounded" and got[2].answer == api.REFUSAL and got[7].trust_status == "fully_grounded"
    assert got[7].verification_level == "exact_match_and_deterministic_consistency" and "SAFETY_NOT_EVALUATED" in got[1].limitations
    assert "SEMANTIC_ENTAILMENT_INCOMPLETE" in got[6].limitations
    assert api.finalize(answers.limit(0), evidence, None, questions).count() == 0
