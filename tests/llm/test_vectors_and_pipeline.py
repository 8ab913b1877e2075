import numpy as np

import corpus_pipeline
from lodeworks.llm import common, embeddings, graph
from tests.conftest import SMALL


def exact(ids, vs, least=0.9):
    good = [i for i, v in enumerate(vs) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = list(range(len(ids))), [0] * len(ids)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d in {len(vs[i]) for i in good}:
        own = [i for i in good if len(vs[i]) == d]
        x = np.array([vs[i] for i in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        for a, i in enumerate(own):
            links[i] = int(near[a].sum())
            for b in np.flatnonzero(near[a]):
                u, v = root(i), root(own[b])
                u, v = (u, v) if ids[u] <= ids[v] else (v, u)
                parent[v] = u
    return {ids[i]: (links[i], ids[root(i)]) for i in range(len(ids))}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 8))
    vs = [(base[rng.integers(40)] + rng.normal(size=8) * 0.25).astype(np.float32).tolist() for _ in range(400)]
    vs += vs[:30] + [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] + [1.0] * 6, [float("inf")] * 8, [1.0, 2.0], [2.0, 4.0]]
    ids = rng.permutation(len(vs)).tolist()
    df = spark.createDataFrame([(i, v, "x") for i, v in zip(ids, vs, strict=True)], "vec_id long, embedding array<float>, node string")
    got = embeddings.near_vectors(df.repartition(3)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == exact(ids, vs)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_vectors_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6))
    vs = [(base[rng.integers(60)] + rng.normal(size=6) * 0.3).tolist() for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>")
    cut = embeddings._cut
    monkeypatch.setattr(embeddings, "_cut", lambda axes, kind: cut(axes, kind, 20))
    got = embeddings.near_vectors(df.repartition(4)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == exact(list(range(700)), vs)


def test_block_pairs_skip_only_far_blocks(spark):
    boxes = spark.createDataFrame([(i, 2, [i * 0.5] + [0.0] * 6, [i * 0.5 + 0.1] + [0.0] * 6) for i in range(30)], "seq long, dim int, lo array<double>, hi array<double>")
    got = {(r.i, r.j) for r in embeddings._block_pairs(boxes, 30, 0.45).collect()}
    assert got == {(i, j) for i in range(30) for j in range(i, 30) if max(0, (j - i) * 0.5 - 0.1) <= 0.45 + 1e-6}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[1000 + i] for i in range(50)}) == 1 and roots[0] != roots[1000] and 5000 not in roots
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = common.table(spark, SMALL, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.settle(stage(spark, docs, SMALL), name)
        counts.append(docs.count())
        if name != "bpe":
            assert docs.columns == names
        if name == "secrets":
            assert docs.where("n_chars <> length(text)").count() == 0
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[5] == counts[4]
    assert corpus_pipeline.run(spark, SMALL).count() == counts[5]


def test_stages_on_odd_documents(spark, tmp_path):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words, n))
    same = text(60)
    rows = [(i, text(int(rng.integers(5, 80))), "en", "ab"[i % 2], 1, "x", 2) for i in range(60)]
    rows += [(100, same, "en", "a", 1, "x", 2)] * 3 + [(101, same + " more", "en", "b", 1, None, 2), (102, None, None, None, None, "y", 3), (None, "no id here at all", "en", None, 1, "x", 2), (103, "", "en", "a", 0, "x", 2), (104, text(30_000), "en", "b", 1, "x", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxic string, copies int"
    folder = tmp_path.as_uri()
    marks = [(i, 1, int(i < 6)) for i in range(40)] + [(None, 0, 1), (5000, 1, 1), (7, None, None)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    docs, kept = common.table(spark, folder, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.settle(stage(spark, docs, folder), f"test-{name}")
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    ids = {n: [r.doc_id for r in rs] for n, rs in kept.items()}
    assert ids["near_duplicates"].count(100) == 1 and 101 not in ids["near_duplicates"] and {102, 103, 104, None} <= set(ids["near_duplicates"])
    assert sorted(map(str, ids["secrets"])) == sorted(map(str, ids["near_duplicates"]))
    assert len(ids["bpe"]) == len(ids["mixture"]) == sum(1 for _ in corpus_pipeline.run(spark, folder).collect())
    docs_of = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs_of = stage(spark, docs_of, folder)
        assert docs_of.count() == 0

