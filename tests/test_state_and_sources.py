import zipfile

import pytest
from pyspark.sql import functions as F

from lodeworks import api
from lodeworks.plugins import HashingEmbedder
from lodeworks.sources import loaders
from lodeworks.sources.collections import CollectionStore, owns
from lodeworks.streaming import incremental, state
from tests.conftest import SMALL


def test_rate_limit(spark):
    rows = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate((0, 10, 20, 61))], "key long, seq long, t double")
    got = [(r["admitted"], r["retry_after"]) for r in state.rate_limit(rows, 2, 60).orderBy("seq").collect()]
    assert got == [(True, 0), (True, 0), (False, 40), (True, 0)]


def test_streaming_rate_limit_equals_batch(spark):
    from lodeworks.plans import registry

    key = lambda r: (r["key"], r["seq"], r["admitted"], r["retry_after"])
    q = registry.queries()
    assert sorted(map(key, q["streaming_rate_limit"](spark, SMALL).collect())) == sorted(map(key, q["rate_limit_replay"](spark, SMALL).collect()))


def test_job_states(spark):
    events = ["claim", "fail", "claim", "fail", "claim", "fail"]
    rows = [(1, i, e) for i, e in enumerate(events)] + [(2, 0, "claim"), (2, 1, "succeed"), (3, 0, "claim"), (3, 1, "expire")]
    got = {r["job"]: (r["status"], r["retries"]) for r in state.job_states(spark.createDataFrame(rows, "job long, seq long, event string"), 3).collect()}
    assert got == {1: ("dead_letter", 3), 2: ("succeeded", 1), 3: ("queued", 1)}


def test_circuit_breaker(spark):
    calls = [("p", 0, 0.0, False), ("p", 1, 1.0, False), ("p", 2, 2.0, True), ("p", 3, 40.0, True), ("p", 4, 41.0, True)]
    got = [r["state"] for r in state.circuit_breaker(spark.createDataFrame(calls, "provider string, seq long, t double, ok boolean"), 2, 30).orderBy("seq").collect()]
    assert got == ["closed", "closed", "open", "half_open", "closed"]


def test_dag_and_chain(spark):
    good = [{"id": "p", "type": "parse", "next": ["c"]}, {"id": "c", "type": "chunk", "next": ["i"]}, {"id": "i", "type": "index"}]
    assert incremental.parse_dag(good) == ["p", "c", "i"]
    with pytest.raises(ValueError):
        incremental.parse_dag([*good, {"id": "x", "type": "index"}])
    versions = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "id string, parent string")
    assert [r["id"] for r in incremental.config_chain(versions, "c").orderBy("depth").collect()] == ["c", "b", "a"]


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.jsonl").write_text('{"text": "one", "k": "v"}\n{broken\n{"text": "two"}\n')
    (tmp_path / "c.json").write_text('[{"text": "three"}]')
    (tmp_path / "d.csv").write_text("x,y\n1,2\n")
    (tmp_path / "e.html").write_text("<html><style>p{}</style><p>Hi &amp; bye</p></html>")
    slide = '<p:sld xmlns:p="p" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:p><a:r><a:t>Title</a:t></a:r></a:p><a:tbl><a:tr><a:tc><a:p><a:t>c1</a:t></a:p></a:tc><a:tc><a:p><a:t>c2</a:t></a:p></a:tc></a:tr></a:tbl></p:sld>'
    with zipfile.ZipFile(tmp_path / "f.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide)
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "g.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/><sheet name="H" state="hidden" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c r="A1"><v>1</v></c><c r="C1"><v>2</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>')
    texts = {r["page_content"] for r in loaders.LoaderRegistry().load_directory(spark, str(tmp_path)).collect()}
    assert texts == {"plain text", "one", "two", "three", "x: 1; y: 2", "Hi & bye", "Title", "c1 | c2", "1 | 2\n1 | "}
    with pytest.raises(ValueError):
        loaders.LoaderRegistry().register("again", loaders.load_text, ("txt",))
    assert spark.range(1).select(loaders.upload_verdict(F.lit("a.pdf"), F.lit(bytearray(b"%PDF-1"))), loaders.upload_verdict(F.lit("a.pdf"), F.lit(bytearray(b"PK\x03\x04"))), loaders.upload_verdict(F.lit("a.exe"), F.lit(bytearray(b"MZ")))).first()[:] == ("accepted", "conflict", "unsupported")


def test_collection_lifecycle(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("alpha beta gamma")
    (source / "b.txt").write_text("delta epsilon zeta")
    store = CollectionStore(spark, str(tmp_path / "store"))
    first = api.load_from_local_files(spark, str(source), store, "docs")
    assert owns("docs", first) and store.describe("docs")["rows"] == 2
    hits = api.retrieve(store, "docs", [(0, "epsilon")], 1, embedder=HashingEmbedder()).collect()
    assert [h["text"] for h in hits] == ["delta epsilon zeta"]
    second = api.load_from_local_files(spark, str(source), store, "docs")
    assert [r["physical"] for r in store.list().collect()] == [second]
    assert store.rollback("docs") == first
    gone = store.read("docs").where("text like 'alpha%'").select("document_id")
    store.delete_documents("docs", gone)
    assert store.describe("docs")["rows"] == 1
    third = store.compact("docs")
    assert spark.read.parquet(f"{store.root}/{third}").count() == 1
    with pytest.raises(ValueError):
        store.activate("docs", "other__v_1_ab")
    with pytest.raises(ValueError):
        store.init("docs", 64, force_new=True)
    assert set(store.drop("docs")) == {first, second, third} and store.list().count() == 0


def test_finalize(spark):
    answers = spark.createDataFrame([(1, "A [E1]. B."), (2, "Nothing."), (3, None)], "answer_id long, answer string")
    evidence = spark.createDataFrame([(1, "E1")], "answer_id long, evidence_id string")
    got = {r["answer_id"]: (r["original_state"], r["action"], r["answer"], r["state"]) for r in api.finalize(answers, evidence).collect()}
    refused = ("insufficient_evidence", "refuse", api.REFUSAL, "insufficient_evidence")
    assert got == {1: ("partially_grounded", "downgrade", "A.[E1]", "fully_grounded"), 2: refused, 3: refused}


def test_finalize_holds_claims_against_texts_and_findings(spark):
    answers = spark.createDataFrame(
        [(1, "Version 2.3.1 is out [E1]. It needs 5 GB [E2]."), (2, "The limit is 9 GB [E1]."), (3, "Old and new differ [CONFLICT:E1,E2]. Plain."), (4, "Up is down [E1]. Kept as is [E2].")],
        "answer_id long, answer string",
    )
    evidence = spark.createDataFrame(
        [(1, "E1", "Version 2.3.1 is out."), (1, "E1", "Version 2.3.1 is out."), (1, "E2", "It needs 7 GB."), (2, "E1", None), (3, "E1", "old"), (3, "E2", "new"), (4, "E1", "Up is up"), (4, "E2", "Kept as is.")],
        "answer_id long, evidence_id string, text string",
    )
    findings = spark.createDataFrame([(4, 1, "contradicted", 0.9)], "answer_id long, claim_index int, verdict string, confidence double")
    exact = {(r["answer_id"], r["claim_index"]): (r["exact"], r["effective_status"]) for r in api.assess(answers, evidence).collect()}
    assert exact[1, 1] == (True, "supported") and exact[1, 2] == (False, "unsupported") and exact[4, 2] == (True, "supported")
    got = {r["answer_id"]: (r["action"], r["answer"], r["state"]) for r in api.finalize(answers, evidence, findings).collect()}
    assert got[1] == ("downgrade", "Version 2.3.1 is out.[E1]", "fully_grounded")
    assert got[2] == ("refuse", api.REFUSAL, "insufficient_evidence")
    assert got[3][0] == "disclose_conflict" and got[3][2] == "conflicting_evidence"
    assert got[4] == ("downgrade", "Kept as is.[E2]", "fully_grounded")
    assert api.finalize(answers.limit(0), evidence).count() == 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
