import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from lodeworks.llm import maxscore, negatives, runs
from tests.conftest import SMALL

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w):
    """Runs by trying every period from every word."""
    best = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in best.items())


def expected(doc_id, text, rewrite=True):
    w = SPACE.findall(text or "")
    if rewrite and w and doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    lead = min(((-n, s, q) for s, n, q in found), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
    return (
        len(found), *((lead[1], -lead[0], lead[2], 1000 * -lead[0] // lead[2]) if lead else (None,) * 4),
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest(),
    )


def test_gram_is_the_least_overlap():
    assert runs.GRAM == 5


def test_runs_of_random_words_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(600):
        docs = []
        for _ in range(rng.integers(1, 5)):
            n, p = int(rng.integers(0, 60)), int(rng.integers(1, 8))
            w = rng.integers(0, rng.integers(1, 5), n).tolist()
            a = int(rng.integers(0, n)) if n else 0
            docs.append([w[i] if i < a or rng.random() < 0.03 else w[a + (i - a) % p] for i in range(n)] if rng.random() < 0.6 else w)
        ids, doc = np.array(sum(docs, []), np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        begin = np.cumsum([0, *map(len, docs)])
        got = list(zip(*(x.tolist() for x in runs._runs_of(ids, doc)), strict=True))
        assert got == [(begin[i] + s, n, q) for i, d in enumerate(docs) for s, n, q in all_runs(d)]


def test_runs_query_equals_brute_force_on_whole_texts(spark):
    got = {r.doc_id: tuple(r)[1:] for r in runs.op12(spark, SMALL).collect()}
    docs = duckdb.sql(f"select doc_id, text from '{SMALL}/documents.parquet'").fetchall()
    assert len(got) == len(docs) and any(r[0] for r in got.values())
    wrong = [d for d, t in docs if len(SPACE.findall(t or "")) < 3000 and got[d] != expected(d, t)]
    assert not wrong


def test_runs_of_odd_texts(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x " * 3 + " é é\n" * 4, "a b " * 4, "b a b a b a b a c", "p q r " * 30_000, "one two three four five\x0b" * 3]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "a " * 9, "c"), (3, "a", "c"), (3, "a", "c")], "doc_id long, text string, runs string")
    got = runs.periodic_runs(docs.repartition(3)).collect()
    assert len(got) == 14 and sum(r.doc_id == 3 for r in got) == 3
    for r in got:
        if r.doc_id is not None and r.doc_id != 9:
            assert tuple(r)[1:8] == expected(r.doc_id, texts[r.doc_id], rewrite=False)
    by_id = {r.doc_id: r for r in got}
    assert by_id[9].runs[0].asDict() == {"start": 0, "length": 90_000, "period": 3} and by_id[9].collapsed == "p q r"
    assert by_id[None].collapsed == "a" and by_id[None].exponent_milli == 9000
    assert runs.periodic_runs(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(12, 6))
    vs = [(base[rng.integers(12)] + rng.normal(size=6) * 0.4).tolist() for _ in range(700)] + [np.abs(rng.normal(size=6) * (rng.random(6) < 0.3)).tolist() for _ in range(200)]
    vs += vs[:40] + [vs[0]] * 60 + [[1.0, 2.0], [2.0, 1.0], [-1.0, 0.5], [0.0] * 6]
    rows = [(int(i), v, int(rng.integers(0, 10)), "x") for i, v in enumerate(vs)]
    rows += [(950, vs[3], None, "x"), (100, vs[7], 3, "x"), (None, vs[0], 2, "x"), (2000, None, 1, "x"), (2050, [], 1, "x"), (2100, [1.0, None] + [1.0] * 4, 1, "x"), (2150, [float("nan")] * 6, 1, "x"), (2200, [float("inf")] * 6, 1, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string").repartition(5)


def against_sql(df, sql):
    con = duckdb.connect()
    con.register("e", df.toArrow())
    con.execute("create view embeddings as select * from e")
    return sorted(con.sql(sql).fetchall(), key=str)


def test_top_five_of_odd_vectors(odd_vectors):
    got = sorted((tuple(r) for r in maxscore.exact_top(odd_vectors).collect()), key=str)
    assert got == against_sql(odd_vectors, maxscore.OP11_SQL) and len(got) > 50


def test_negatives_of_odd_vectors(odd_vectors):
    from pyspark.sql import functions as F

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = sorted((tuple(r) for r in negatives.hard_negatives(odd_vectors, label).collect()), key=str)
    assert got == against_sql(odd_vectors, negatives.OP13_SQL) and len(got) > 50


@pytest.mark.parametrize(("query", "sql"), [(maxscore.op11, maxscore.OP11_SQL), (negatives.op13, negatives.OP13_SQL)])
def test_vector_queries_equal_sql(spark, query, sql):
    got = query(spark, SMALL)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({sql})").fetchall())


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert maxscore.exact_top(none).count() == 0 and negatives.hard_negatives(none).count() == 0


def test_large_components_stay_exact(spark):
    big = [[3e12, -1e12], [3e12, -1e12 + 1 / 128], [2e12, 5e11], [1.0, 1.0]]
    df = spark.createDataFrame([(50 * i, v, i % 2) for i, v in enumerate(big)], "vec_id long, embedding array<double>, label int")
    small = np.array([[int(256 * x) for x in v] for v in big], object) // 2**20  # fits a long once scaled down
    assert negatives.products(small, small).dtype == np.int64
    assert negatives.products(small, small).tolist() == (small @ small.T).tolist()
    with pytest.raises(OverflowError):
        negatives.products(np.array([[2**62, 2**62]]), np.array([[4, 4]]))
    with pytest.raises(Exception, match="OverflowError|too large|overflow"):
        maxscore.exact_top(df).collect()


def test_maxscore_reads_few_lists_of_sparse_vectors():
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.abs(rng.normal(size=(6000, 64))) * (rng.random((6000, 64)) < 0.06) * np.linspace(3, 0.2, 64)).astype(np.int64)
    shards = []
    for at in range(0, 6000, 1000):
        block = type("B", (), {"width": 64, "numbers": [np.arange(at, at + 1000)] * 3 + list(maxscore.Shard.arrays(x[at : at + 1000]))})()
        shards.append(maxscore.Shard(block))
    counts = np.zeros(4, np.int64)
    asked = x[::50]
    best = [[] for _ in asked]
    for shard in shards:
        floors = np.array([b[-5] if len(b) >= 5 else 0 for b in best], np.int64)
        for q, _, s in zip(*(c.tolist() for c in maxscore.competitors(shard, asked, floors, 5, counts)), strict=True):
            best[q] = sorted([*best[q], s])[-5:]
    assert best == [np.sort(x @ q)[-5:].tolist() for q in asked]
    assert counts[1] < 0.9 * counts[0]
