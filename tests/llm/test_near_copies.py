"""Near-duplicates in groups larger than a bucket, a block or a task, against all pairs."""

import random

import numpy as np

from lodeworks.llm import graph, minhash


def roots_by_all_pairs(texts):
    """Smallest index reachable over exact links, from one product of the whole incidence matrix."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    column = {s: k for k, s in enumerate({s for x in sets for s in x})}
    inside = np.zeros((len(sets), len(column)), np.float32)
    for i, x in enumerate(sets):
        inside[i, [column[s] for s in x]] = 1
    sizes = inside.sum(axis=1)
    root = np.arange(len(sets))
    near = []
    for at in range(0, len(sets), 500):
        both = inside[at : at + 500] @ inside.T
        union = sizes[at : at + 500, None] + sizes[None, :] - both
        near.append((100 * both >= 75 * union) & (both > 0))
    near = np.concatenate(near)
    while True:
        best = np.array([root[row].min() if row.any() else root[i] for i, row in enumerate(near)])
        best = np.minimum(best, root)
        if (best == root).all():
            return root.tolist()
        root = best


def near_copies(n, seed, words=60):
    """Texts with up to ten changes to one base, so that some link with it, some only through others and some not at all."""
    rnd = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for at in rnd.sample(range(0, words, 6), min(words // 6, rnd.choice([0, 1, 1, 2, 2, 3, 5, 8]))):
            t[at] = f"c{at}x{rnd.randint(0, 3)}"
        out.append(" ".join(t))
    return out


def test_a_group_longer_than_a_bucket_equals_all_pairs(spark):
    texts = near_copies(5600, 3) + [f"lone text number {i} of its own kind here" for i in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    expected = roots_by_all_pairs(texts)
    assert len(set(expected)) > 55 and got == dict(enumerate(expected))


def test_small_buckets_and_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET", 8)
    monkeypatch.setattr(minhash, "_BLOCK", 2000)
    rnd = random.Random(5)
    texts = near_copies(150, 4, 40) + near_copies(60, 6, 30) + [" ".join(rnd.choice("pqrs") for _ in range(rnd.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == dict(enumerate(roots_by_all_pairs(texts)))


def test_recall_at_the_threshold(spark):
    """Pairs alone in their groups, with a similarity just at or above 0.75: all are found."""
    rnd = random.Random(8)
    texts = []
    for p in range(700):
        words = [f"p{p}w{k}" for k in range(rnd.randint(106, 122))]
        other = list(words)
        for k in rnd.sample(range(4, len(words) - 4), 3):
            other[k] = "z" + other[k]
        texts += [" ".join(words), " ".join(other)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    expected = roots_by_all_pairs(texts)
    linked = [i for i in range(len(texts)) if expected[i] != i]
    assert len(linked) > 200 and sum(got[i] == expected[i] for i in linked) >= 0.999 * len(linked)
    assert all(got[i] == i for i in range(len(texts)) if expected[i] == i)


def test_forests_of_sets_equal_all_pairs():
    rnd = np.random.default_rng(1)
    for n, spread in ((2, 0.1), (30, 0.02), (200, 0.05), (200, 0.6), (90, 0.15)):
        base = rnd.integers(0, 1 << 62, 120, np.uint64)
        sets = [np.unique(np.where(rnd.random(120) < spread, rnd.integers(0, 1 << 62, 120, np.uint64), base)) for _ in range(n)]
        _, want = graph.roots_of(*(np.nonzero(minhash.similar(sets))))
        x, y = minhash.set_forest(sets)
        nodes, got = graph.roots_of(x, y)
        linked = np.nonzero(minhash.similar(sets).any(axis=0))[0]
        assert nodes.tolist() == linked.tolist() and got.tolist() == want.tolist() and len(x) == len(nodes) - len(set(got.tolist()))


def test_components_in_rounds_and_in_one_task(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000)] + [(7000 + i, 7000 + (i * 7) % 90) for i in range(90)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    whole = {r.node: r.root for r in graph.components(df).collect()}
    rounds = {r.node: r.root for r in graph.components(df, one_task=4).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups(whole) == groups(rounds) and len({whole[i] for i in range(301)}) == 1 and 5000 not in whole
    assert graph.components(df.limit(0)).count() == 0
