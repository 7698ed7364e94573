"""MinHash and vector near-duplicates against brute force."""

import random

import numpy as np
import pytest

from tidewatch.llm import minhash, projections
from tidewatch.llm.common import components


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = roots(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def family(rng, words, base, share):
    return " ".join(rng.choice(words) if rng.random() < share else w for w in base)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        share = rng.choice([0.0, 0.01, 0.03, 0.05, 0.08])
        rows += [family(rng, words, base, share) for _ in range(rng.randint(2, 25))]
    rows += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    rows += [None, "", " \n\t", "one", "ONE", "one two", "One  Two", "one two three", "café", "CAFé", "x " * 4000, "x " * 4000]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k,block", [(2, 1500), (5, 1500), (2, 7)])
def test_documents(documents, corpus, k, block):
    out = minhash.near_duplicates(documents(corpus), k=k, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(corpus, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_documents_repeated_and_missing(documents):
    text = "a b c d e f g h i j"
    out = minhash.near_duplicates(documents([(1, text), (1, text), (None, text), (2, text + " k"), (3, None)]), k=2).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("3", "3", True), ("None", "None", True)]
    assert minhash.near_duplicates(documents([])).collect() == []


def test_sketch_is_full_and_concentrated():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    sets = [np.unique(base[:800]), np.unique(base[100:900]), base[:1], base[:0]]
    s = minhash.sketches(sets)
    assert (s[:3] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (s[3] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 700 / 900) < 0.08


def test_common_counts_by_matrix():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 5000, 300)).astype(np.uint64) for _ in range(40)]
    x, y = np.triu_indices(40, 1)
    assert minhash.common_counts(sets, x, y).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]


def test_components(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 4), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == roots({n for p in real for n in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def vector_rows():
    rng = np.random.default_rng(5)
    rows = [rng.standard_normal(16) for _ in range(120)]
    for share in (0.05, 0.1, 0.3, 0.45):
        base = rng.standard_normal(16)
        rows += [base + share * np.linalg.norm(base) / 4 * rng.standard_normal(16) for _ in range(30)]
    rows += [rows[3] * 2.5, rows[3], rows[3]]
    rows = [r.tolist() for r in rows]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-200, 2e-200]]
    order = rng.permutation(len(rows))
    return [(int(i), rows[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("window,block", [(24, 2000), (8, 20)])
def test_vectors(spark, window, block):
    rows = vector_rows()
    df = spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, label int, rep string, raw string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in projections.near_vectors(df, window=window, block=block).collect()}
    good = {}
    for i, v in rows:
        x = np.array([np.nan if c is None else c for c in v or []], dtype=np.float64)
        if len(x) and np.isfinite(x).all() and x.any() and np.linalg.norm(x) > 0:
            good[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    found = roots(dict(rows), links)
    degree = {i: sum(i in p for p in links) for i, _ in rows}
    assert got == {i: (degree[i], found[i], found[i] == i) for i, _ in rows}


def test_vectors_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert projections.near_vectors(df).collect() == []
    one = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(((r.vec_id or 0), r.n_links, (r.component_id or 0)) for r in projections.near_vectors(one).collect()) == [(0, 0, 0), (4, 1, 4), (4, 1, 4)]
