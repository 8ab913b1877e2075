"""Retrieval loops, manifests, commits over several tables, sync runs, version chains."""

import random
import uuid
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lodeworks.operators import loops, manifests, schedule
from lodeworks.session import work_folder
from lodeworks.sources.commits import TableLog, VersionTaken
from lodeworks.streaming import incremental, sync


def word_search(spark, docs):
    """Every document with one of a query's words, by id."""
    table = spark.createDataFrame([(i, s, w) for i, t, s in docs for w in set(t.split())], "id long, source string, word string")

    def search(asked):
        words = asked.select("qid", "query", F.explode(F.split("query", " ")).alias("word"))
        hits = words.join(table, "word").select("qid", "query", "id", "source").distinct()
        return hits.selectExpr("qid", "query", "cast(row_number() over (partition by qid, query order by id) as int) rank", "id", "source")

    return search


DOCS = [(i, f"w{i % 7} w{i % 5} x{i}", f"s{i % 3}") for i in range(40)] + [(100, "lone", None)]


def by_hand(questions, proposals, rounds, limit):
    """The loop for one question after the other."""
    docs = {i: (set(t.split()), s) for i, t, s in DOCS}
    out = {}
    for qid, broad, risky in questions:
        asked, items, n = set(), {}, 0
        for number in range(1, rounds + 1):
            new = []
            for q in [q for i, r, q in proposals if i == qid and r == number]:
                c = " ".join((q or "").lower().split())
                if c and c not in asked and c not in [x for x, _ in new]:
                    new.append((c, q))
            asked |= {c for c, _ in new}
            if not new:
                out[qid] = (number - 1, n, len(items), len({s for s in items.values() if s}), "no_new_query")
                break
            n += len(new)
            rank = {}
            for _, q in new:
                for k, i in enumerate(sorted(i for i, (w, _) in docs.items() if w & set(q.split(" "))), 1):
                    rank[i] = min(rank.get(i, k), k)
            for i in sorted(rank, key=lambda i: (rank[i], i))[:limit]:
                items.setdefault(i, docs[i][1])
            sources = len({s for s in items.values() if s})
            if number == 1 and not broad and not risky and len(items) >= 4 and sources >= 2:
                out[qid] = (1, n, len(items), sources, "enough_evidence")
                break
            if number == rounds:
                out[qid] = (rounds, n, len(items), sources, "max_rounds")
    return out


def test_rounds_equal_a_loop_over_questions(spark):
    rnd = random.Random(5)
    questions = [(i, rnd.random() < 0.3, rnd.random() < 0.3) for i in range(25)]
    word = lambda: rnd.choice([f"w{rnd.randrange(7)}", f"x{rnd.randrange(45)}", "none", "lone"])
    proposals = [(q, r, " ".join(word() for _ in range(rnd.randint(1, 2)))) for q in range(24) for r in (1, 2, 3) for _ in range(rnd.randint(0, 2))]
    proposals += [(3, 1, None), (3, 2, "  "), (5, 2, proposals[0][2])]
    outcome, evidence = loops.iterative_retrieval(
        spark.createDataFrame(questions + questions[:2], "qid long, comprehensive boolean, high_risk boolean"), spark.createDataFrame(proposals, "qid long, round int, query string"), word_search(spark, DOCS), 3, 6
    )
    got = {r.qid: tuple(r)[1:] for r in outcome.collect()}
    assert got == by_hand(questions, proposals, 3, 6)
    assert {r[-1] for r in got.values()} == {"enough_evidence", "no_new_query", "max_rounds"}
    assert evidence.count() == sum(r[2] for r in got.values()) == evidence.select("qid", "id").distinct().count()


def test_rounds_without_questions(spark):
    none = spark.createDataFrame([], "qid long, comprehensive boolean, high_risk boolean")
    proposals = spark.createDataFrame([], "qid long, round int, query string, enough boolean")
    assert loops.iterative_retrieval(none, proposals, word_search(spark, DOCS))[0].count() == 0
    assert loops.chain_retrieval(none, proposals, word_search(spark, DOCS))[0].count() == 0


def test_chain_stops(spark):
    questions = spark.createDataFrame([(i,) for i in range(6)], "qid long")
    rows = [(0, 1, "w1", False), (0, 2, " W1 ", True), (1, 1, "w1", True), (2, 1, "x3", True), (2, 2, "x4", True), (2, 3, "lone", True), (3, 1, " ", False), (4, 1, "y" * 600, False)]
    rows += [(5, r, f"x{r}", False) for r in (1, 2, 3, 4)]
    steps, evidence = loops.chain_retrieval(questions, spark.createDataFrame(rows, "qid long, round int, query string, enough boolean"), word_search(spark, DOCS))
    last = {r.qid: (r.step, r.n_items, r.stop_reason) for r in steps.where("stop_reason is not null").collect()}
    n = sum("w1" in t.split() for _, t, _ in DOCS)
    assert last == {
        0: (2, n, "duplicate_followup_query"), 1: (1, n, "enough_verified_evidence"), 2: (3, 3, "enough_verified_evidence"), 3: (1, 0, "empty_followup_query"),
        4: (1, 0, "followup_query_too_long"), 5: (4, 4, "max_iterations"),
    }
    confidence = {(r.qid, r.step): (r.confidence, r.gate) for r in steps.collect()}
    assert confidence[2, 1] == (0.333, "insufficient_unique_evidence") and confidence[2, 3] == (1.0, "model_has_enough_verified_evidence")
    assert confidence[5, 3] == (1.0, "model_requests_more_verified_evidence")
    assert evidence.where("qid = 5").count() == 4


def test_manifest_does_not_depend_on_the_order_of_changes(spark):
    rnd = random.Random(8)
    empty = spark.createDataFrame([], "c string, n long, a decimal(20,0), b decimal(20,0), data_version int, note string")

    def state(rows):
        df = spark.createDataFrame(rows, "c string, x string")
        return manifests.state(df.select("c", manifests.fingerprint(x=F.col("x")).alias("h")), "c", "h")

    held, now = [], empty
    for _ in range(5):
        added = [(rnd.choice("pq"), rnd.choice(["same", str(rnd.random()), None])) for _ in range(rnd.randint(1, 30))]
        removed = rnd.sample(held, len(held) // 3)
        for r in removed:
            held.remove(r)
        held += added
        now = manifests.moved(now, "c", state(added), state(removed) if removed else None)
        now = spark.createDataFrame(now.collect(), now.schema)
    scratch = manifests.moved(empty, "c", state(held))
    versions = [{r.c: (r.n, r.v) for r in m.select("c", "n", manifests.version(F.col("n"), F.col("a"), F.col("b")).alias("v")).collect()} for m in (now, scratch)]
    assert versions[0] == versions[1] and sum(n for n, _ in versions[0].values()) == len(held)
    gone = manifests.moved(now, "c", removed=state(held))
    assert {(r.n, int(r.a), int(r.b)) for r in gone.collect()} == {(0, 0, 0)}


def test_append_guard(spark):
    contract = {c: "x" for c in manifests.CONTRACT}
    columns = ["c", *contract]
    schema = ", ".join(f"{c} string" for c in columns)
    held = spark.createDataFrame([("k", *contract.values()), ("m", *contract.values()), ("o", *[None] * 7)], schema)
    current = held.selectExpr("*", "cast(0 as long) n", "cast(0 as decimal(20,0)) a", "cast(0 as decimal(20,0)) b", "1 data_version")
    other = contract | {"metric_type": "L2", "chunk_algorithm": None}
    incoming = spark.createDataFrame([("k", *contract.values()), ("m", *other.values()), ("o", *[None] * 7), ("new", *contract.values())], schema)
    items = spark.createDataFrame([(c, "a" * 64) for c in ("k", "m", "o", "new", "k")], "c string, h string")
    after, refused = manifests.append(current, incoming, items, "c", "h")
    assert {r.c: (r.n, r.data_version) for r in after.collect()} == {"k": (2, 2), "m": (0, 1), "o": (1, 2), "new": (1, 1)}
    assert [(r.c, r.mismatches) for r in refused.collect()] == [("m", ["metric_type", "chunk_algorithm"])]


def folder(spark):
    return f"{work_folder(spark)}/tests/{uuid.uuid4().hex}"


def test_one_version_has_one_writer(spark):
    log = TableLog(spark, folder(spark))
    one = spark.createDataFrame([(1,)], "x int")
    assert log.version() == 0 and log.read("t", "x int").count() == 0
    assert log.commit(0, {"t": one}) == 1
    with pytest.raises(VersionTaken):
        TableLog(spark, log.folder).commit(0, {"t": one.union(one)})
    log.commit(1, {"u": one})
    assert log.read("t", "x int").count() == 1 and log.read("u", "x int").count() == 1 and log.read("u", "x int", 1).count() == 0


class Stop(Exception):
    pass


STEPS = ("planned", "staged items", "staged queue", "staged cursor", "written")


@pytest.mark.parametrize("step", STEPS)
def test_a_sync_run_that_stops_leaves_the_run_before_it(spark, step):
    log = TableLog(spark, folder(spark))
    listing = lambda rows: spark.createDataFrame(rows, "external_id string, mtime long, size long, content_hash string")
    nobody = spark.createDataFrame([], "external_id string")
    sync.run(log, listing([("a", 1, 1, "h"), ("b", 1, 1, "h"), ("c", 1, 1, "h"), ("d", 1, 1, None), (None, 1, 1, "h")]), nobody, 1)
    tables = (("items", sync.ITEMS), ("queue", sync.QUEUE), ("cursor", sync.CURSOR))
    before = [sorted(map(tuple, log.read(*t).collect())) for t in tables]
    again = listing([("a", 2, 1, "h2"), ("b", 2, 1, "h"), ("d", 2, 2, "h"), ("e", 1, 1, "h")])

    def stop(at):
        if at == step:
            raise Stop

    with pytest.raises(Stop):
        sync.run(log, again, nobody, 2, stop)
    assert [sorted(map(tuple, log.read(*t).collect())) for t in tables] == before and log.version() == 1
    counts = sync.run(log, again, spark.createDataFrame([("c",)], "external_id string"), 2)
    assert counts == {"updated": 1, "skipped": 1, "added": 2, "retained": 1}
    cursor = {r.external_id: (r.mtime, r.size) for r in log.read("cursor", sync.CURSOR).collect()}
    assert cursor == {"a": (2, 1), "b": (2, 1), "c": (0, 0), "d": (2, 2), "e": (1, 1)}
    assert {r.external_id: r.attempt for r in log.read("queue", sync.QUEUE).where("run = 2").collect()} == {"a": 2, "d": 1, "e": 1}
    assert sync.run(log, again, nobody, 3) == {"deleted": 1, "unchanged": 4}
    assert {r.external_id for r in log.read("items", sync.ITEMS).where("status = 'deleted'").collect()} == {"c"}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    settle = incremental.settle
    monkeypatch.setattr(incremental, "settle", lambda df, name: rounds.append(name) or settle(df, name))
    n = 10_000
    versions = spark.range(n).selectExpr("id", "case when id > 0 then id - 1 end parent").unionByName(spark.createDataFrame([(n + 1, n + 5)], "id long, parent long"))
    got = incremental.roots(versions)
    assert got.where(f"id < {n} and (root <> 0 or depth <> id)").count() == 0 and got.count() == n + 1
    assert got.where(f"id = {n + 1}").collect()[0][1:] == (n + 1, 0)
    assert len(rounds) < 20
    head = spark.createDataFrame([(n - 1,), (5,)], "id long")
    found = incremental.chains(versions, head)
    assert found.count() == n + 6 and found.where("head - depth <> id").count() == 0
    with pytest.raises(ValueError):
        incremental.roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "id long, parent long"))


def cron_set(text, low, high):
    out = set()
    for part in text.split(","):
        base, _, step = part.partition("/")
        a, b = (low, high) if base == "*" else (int(base.split("-")[0]), int(base.split("-")[-1]) if "-" in base else high if step else int(base))
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def next_minute(cron, now, zone):
    """The first of the following minutes whose local time matches; none in 40 days."""
    fields = cron.split()
    m, h, d, mo, w = (cron_set(f, lo, hi) for f, lo, hi in zip(fields, (0, 0, 1, 1, 0), (59, 23, 31, 12, 7), strict=True))
    w, either, t = {x % 7 for x in w}, fields[2] != "*" and fields[4] != "*", now.replace(second=0)
    for _ in range(40 * 1440):
        t += timedelta(minutes=1)
        at = t.astimezone(zone)
        if at.minute in m and at.hour in h and at.month in mo:
            a, b = at.day in d, at.isoweekday() % 7 in w
            if (a or b) if either else (a and b):
                return t
    return None


def test_next_runs_equal_a_search_over_minutes(spark):
    rnd = random.Random(3)
    crons = ["* * * * *", "*/15 * * * *", "30 1 * * *", "30 2 * * *", "15 1-3 * * 0", "0 9-17/2 * * 1-5", "5,35 */6 10-20 * *", "0 12 13 * 5", "*/7 1,2 * * *", "0 3 * * 7", "10 2 */3 * *"]
    zones = ["Asia/Shanghai", "America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "UTC"]
    changes = [datetime(2024, 3, 10, 7), datetime(2024, 11, 3, 6), datetime(2024, 3, 31, 1), datetime(2024, 10, 27, 1), datetime(2024, 4, 6, 15), datetime(2024, 10, 5, 15, 30)]
    rows = []
    for i in range(400):
        near = rnd.choice(changes) + timedelta(minutes=rnd.randint(-300, 300))
        at = near if i % 4 else datetime(2024, 1, 1) + timedelta(minutes=rnd.randint(0, 525_600))
        rows.append((i, rnd.choice(crons), at.replace(second=rnd.randint(0, 59), tzinfo=timezone.utc), rnd.choice(zones)))
    df = spark.createDataFrame([(i, c, int(t.timestamp()), z) for i, c, t, z in rows], "i long, c string, t long, z string")
    got = {r.i: r.n for r in df.select("i", F.unix_seconds(schedule.next_run(F.col("c"), F.timestamp_seconds("t"), F.col("z"))).alias("n")).collect()}
    expected = {i: next_minute(c, t, ZoneInfo(z)) for i, c, t, z in rows}
    assert {i: got[i] for i, e in expected.items() if e} == {i: int(e.timestamp()) for i, e in expected.items() if e}


def test_odd_schedules(spark):
    odd = {"0 0 29 2 *": "2028-02-29", "0 0 30 2 *": None, "a * * * *": None, "* * * *": None, "60 * * * *": None, "0 0 * jan mon-fri": "2025-01-01", "*/0 * * * *": None, "5-1 * * * *": None, "": None, " 0  0 * * 1-7 ": "2024-03-02"}
    df = spark.createDataFrame([*[(c,) for c in odd], (None,)], "c string")
    now = F.lit("2024-03-01 00:00:30").cast("timestamp")
    got = {r.c: r.d for r in df.select("c", F.date_format(schedule.next_run(F.col("c"), now, F.lit("UTC")), "yyyy-MM-dd").alias("d")).collect()}
    assert got == odd | {None: None}
