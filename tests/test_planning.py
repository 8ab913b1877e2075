"""Hand-made cases of planning, entailment, records and access, beside the queries' SQL twins."""

import random

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import entailment, grounding, planning, records, relational, retrieval, understanding
from lodeworks.operators.text import anchor_terms
from lodeworks.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def strings(*items):
    return F.array(*(F.lit(i) for i in items)).cast("array<string>")


def test_valid_strings_name_every_cause(spark):
    got = one(spark, planning.valid_strings(strings(" a ", None, "", "a", "x" * 9, "old", "b", "c"), 2, 8, strings("old")))
    assert got["kept"] == ["a", "b"]
    assert got["rejected"] == ["<NoneType>", "<empty>", "<duplicate>", "<too_long>", "<previous_query>", "<over_limit>"]
    assert one(spark, planning.valid_strings(F.lit(None).cast("array<string>"), 2))["kept"] == []


@pytest.mark.parametrize(("values", "kept", "fallback"), [([2, 0, 2, 9, -1], [2, 0], False), ([7], [], True), ([], [], False)])
def test_valid_indices(spark, values, kept, fallback):
    got = one(spark, planning.valid_indices(F.array(*map(F.lit, values)).cast("array<int>"), F.lit(3)))
    assert (got["kept"], got["fallback"]) == (kept, fallback)


@pytest.mark.parametrize(("said", "index", "reason"), [(" 2 ", 1, None), ("two", 0, "invalid_index_format"), ("9", 0, "index_out_of_range"), ("0", 0, "index_out_of_range"), ("9" * 30, 0, "index_out_of_range"), (None, 0, "invalid_index_format")])
def test_agent_index(spark, said, index, reason):
    got = one(spark, planning.agent_index(F.lit(said).cast("string"), 3))
    assert (got["index"], got["reason"]) == (index, reason)


def test_subqueries_keep_to_the_question(spark):
    got = one(spark, understanding.valid_subqueries(F.lit("index build cost"), strings("index", "INDEX", "weather", " ", "build time", "cost of it", "index cost"), anchor_terms))
    assert got == ["index build cost", "index", "build time", "cost of it"]


def test_followups_are_compared_by_what_they_say(spark):
    row = spark.createDataFrame([("ＡＢＣ-def",), ("straße!",), (None,)], "q string").select(planning.comparable("q").alias("c")).collect()
    assert [r.c for r in row] == ["abcdef", "strasse", ""]


def test_exact_clause_needs_the_whole_clause(spark):
    text = "First part, the limit is 5; more."
    at = text.index("the limit is 5")
    ask = lambda claim, s, e: one(spark, entailment.exact_clause(F.lit(claim), F.lit(text), F.lit(s), F.lit(e)))
    assert ask("The Limit is 5.", at, at + 14) and not ask("limit is 5", at + 4, at + 14) and not ask("the limit is 5", at, at + 400) and not ask("", at, at + 14)


def test_a_claim_with_two_findings_stays_unknown(spark):
    claims = spark.createDataFrame([(1, i, "supported", "supported", ["E1"], False) for i in (1, 2, 3)], "answer_id long, claim_index int, status string, effective_status string, evidence_ids array<string>, exact boolean")
    findings = spark.createDataFrame([(1, 1, "entailed", 0.9), (1, 2, "entailed", 0.9), (1, 2, "contradicted", 0.9), (1, 3, "contradicted", float("nan"))], "answer_id long, claim_index int, verdict string, confidence double")
    got = {r.claim_index: (r.entailment, r.effective_status) for r in entailment.entail(claims, findings).collect()}
    assert got == {1: ("entailed", "supported"), 2: ("unknown", "supported"), 3: ("unknown", "supported")}
    off = {r.reason for r in entailment.entail(claims, None).collect()}
    assert off == {"ENTAILMENT_CHECKER_DISABLED"}


def test_spans_equal_a_search_over_all_sentences():
    rnd = random.Random(2)
    words = ["limit", "size", "5", "6", "page", "file", "größe", "max"]

    def fold(t):
        return "".join(c.casefold() for c in t if not c.isspace() and c not in grounding._SKIPPED)

    def pairs(t):
        return {t[i : i + 2] for i in range(len(t) - 1)} or ({t} - {""})

    for _ in range(400):
        sentences = [" ".join(rnd.choices(words, k=rnd.randint(1, 6))) + rnd.choice(".。!；") for _ in range(4)]
        sentences = [s.replace(".", "。") for s in sentences]
        evidence, claim = " ".join(sentences), " ".join(rnd.choices(words, k=rnd.randint(1, 6)))
        kind, start, end, score = grounding.span_of(claim, evidence)
        if fold(claim) in fold(evidence):
            assert kind == "normalized_exact" and fold(evidence[start:end]) == fold(claim)
            continue
        own = pairs(fold(claim))
        figures = {w for w in claim.split() if w.isdigit()}
        scores = []
        for s in sentences:
            theirs = {w.strip("。!；") for w in s.split()} & {"5", "6"}
            shared = len(own & pairs(fold(s)))
            ok = shared >= max(3, 0.35 * len(own)) and not (figures and theirs and not figures <= theirs)
            scores.append(shared / len(own) if ok else 0)
        assert (kind == "not_found") == (max(scores) == 0) and score == round(max(scores), 4)
        if kind != "not_found":
            assert evidence[start:end] == sentences[scores.index(max(scores))]


def test_long_chains_reach_the_root_and_loops_are_errors(spark):
    rows = [(f"v{i}", f"v{i + 1}" if i < 80 else None) for i in range(81)]
    got = incremental.config_chain(spark.createDataFrame(rows, "id string, parent string").coalesce(1), "v0")
    assert got.count() == 81
    with pytest.raises(ValueError):
        incremental.config_chain(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string"), "a")


def test_claims_are_cut_at_their_own_limit(spark):
    answers = spark.createDataFrame([(1, "x" * 900 + " [E1].")], "answer_id long, answer string")
    assert [len(r.text) for r in grounding.claims(answers).collect()] == [600]


def test_pages_and_leases(spark):
    rows = spark.range(25)
    page, total = records.page_with_total(rows, [F.col("id")], 3, 10)
    assert [r.id for r in page.collect()] == [20, 21, 22, 23, 24] and total.first()["total"] == 25
    assert [one(spark, records.lease_free(F.lit(x).cast("int"), F.lit(5))) for x in (None, 5, 6)] == [True, True, False]


def test_access_plans_multiply_nobody(spark):
    users = spark.createDataFrame([(1, "d", "user", True), (2, "d", "admin", True), (3, None, "user", False)], "user long, department string, role string, active boolean")
    bases = spark.createDataFrame([(10, True), (11, False), (12, False)], "base long, company_wide boolean")
    by_department, direct = spark.createDataFrame([("d", 11)], "department string, base long"), spark.createDataFrame([(1, 11), (3, 12)], "user long, base long")
    rules = relational.access_rules(users, by_department, direct)
    assert sorted((r.user, r.rule) for r in rules.collect()) == [(1, "company_wide"), (1, "granted"), (2, "all")]
    asked = spark.createDataFrame([(u, b) for u in (1, 2, 3, 4) for b in (10, 11, 12, 13)], "user long, base long")
    assert {(r.user, r.base) for r in relational.may_access(asked, bases, rules).collect() if r.allowed} == {(1, 10), (1, 11), (2, 10), (2, 11), (2, 12)}
    assert {r.base: r.members for r in relational.members_per_base(bases, rules).collect()} == {10: 2, 11: 2, 12: 1}


def test_searches_in_blocks_equal_the_search_of_a_list(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(5)] if i % 17 else None, i % 3) for i in range(200)] + [(500, [1.0, 2.0], 0), (None, [0.0] * 5, 1)]
    corpus = spark.createDataFrame(rows, "id long, embedding array<double>, label int").repartition(5)
    chosen = [(r[0], r[1]) for r in rows if r[0] is not None and r[0] % 10 == 1 and r[1]]
    for metric in ("cosine", "l2"):
        a = sorted(map(tuple, retrieval.dense_topk(chosen, corpus, 4, metric).collect()))
        b = sorted(map(tuple, retrieval.dense_topk_rows(corpus.where("id % 10 = 1"), corpus, 4, metric).collect()))
        assert a == b and len(a) == 4 * len(chosen)
    by = retrieval.dense_topk_rows(corpus.where("id % 10 = 1"), corpus, 2, "ip", by="label").collect()
    assert len(by) == 2 * 3 * len(chosen) and {type(r.label) for r in by} == {int}
