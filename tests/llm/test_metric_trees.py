"""Vector codes by metric trees, against plain k-means over integers."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tidewatch.llm import metric_trees


def plain(rows, parts, entries, rounds, scale):
    """rows: (id, vector, label) of one length, in the order of their ids."""
    x = np.floor(np.array([v for _, v, _ in rows], dtype=np.float64) * scale).astype(np.int64)
    cuts = metric_trees.cuts(x.shape[1], parts)
    books, codes, errors = [], [], np.zeros(len(x), np.int64)
    for cut in cuts:
        p = x[:, cut]
        c = p[:entries].copy()
        for r in range(rounds + 1):
            d = ((p[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
            own = d.argmin(axis=1)
            if r < rounds:
                for e in np.unique(own):
                    c[e] = p[own == e].sum(axis=0) // (own == e).sum()
        books.append(c)
        codes.append(own)
        errors += d[np.arange(len(p)), own]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] += int(e)
    text = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1)).encode()).hexdigest()
    return sorted([(i, "".join(f"{c[k]:02x}" for c in codes), int(errors[k]), by_label[label], text) for k, (i, _, label) in enumerate(rows)], key=str)


def vectors(n, d, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((12, d))
    x = base[rng.integers(0, 12, n)] + rng.standard_normal((n, d)) * rng.choice([0, 0.01, 0.5], n)[:, None]
    x[n // 2 :: 7] = x[0]  # a large group of copies
    x[5::11, : d // 4] = 0
    return [(i, x[i].tolist(), None if i % 9 == 0 else i % 5) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<double>, label int, size string, error string")


def got(df):
    return sorted([tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()], key=str)


@pytest.mark.parametrize("n,d,entries,leaf,block", [(900, 16, 64, 24, 8192), (900, 16, 64, 1, 100), (500, 18, 256, 5, 300), (40, 8, 256, 24, 8192), (3, 2, 4, 1, 2)])
def test_codes(spark, n, d, entries, leaf, block):
    rows = vectors(n, d)
    out, _ = metric_trees.compress(frame(spark, rows), entries=entries, leaf=leaf, block=block)
    assert got(out) == plain(rows, 4, entries, 4, 1024)


def test_unusable_and_repeated_rows(spark, monkeypatch):
    rows = vectors(60, 8)
    bad = [(200, None, 1), (201, [1.0, None] * 4, 2), (202, [float("nan")] * 8, 3), (203, [float("inf")] + [0.0] * 7, 4)]
    same = [(-5, [0.25] * 8, 3), (-5, [0.25] * 8, 3)]
    want = plain(same + rows, 4, 16, 4, 1024)
    out, _ = metric_trees.compress(frame(spark, rows + bad + same), entries=16)
    assert got(out) == want
    monkeypatch.setattr(metric_trees, "BROADCAST_ROWS", 0)
    assert got(metric_trees.compress(frame(spark, rows + bad + same), entries=16)[0]) == want
    nameless = got(metric_trees.compress(frame(spark, [*rows, (None, [0.5] * 8, 1)]), entries=16)[0])
    assert len(nameless) == 61 and sum(r[0] is None for r in nameless) == 1


def test_lengths_and_extremes(spark):
    rows = vectors(30, 8)
    huge = [(1000 + i, [3e4 * (-1) ** i, i * 1e4, 0.0, 1e300 if i == 3 else 5.0], None) for i in range(6)]
    out, books = metric_trees.compress(frame(spark, rows + huge + [(2000, [], 7)]), entries=4)
    assert sorted(books) == [0, 4, 8]
    found = {r.vec_id: r for r in out.collect()}
    assert len(found) == 37 and found[2000].error == 0 and found[2000].code == "00000000"
    large = np.clip(np.floor(np.array([v for _, v, _ in huge]) * 1024), -(2**25), 2**25).astype(np.int64)
    whole = plain([(i, (x / 1024).tolist(), None) for (i, _, _), x in zip(huge, large, strict=True)], 4, 4, 4, 1024)
    assert sorted([(i, found[i].code, found[i].error) for i, *_ in huge], key=str) == [r[:3] for r in whole]


def test_empty_table(spark):
    assert metric_trees.compress(frame(spark, []))[0].collect() == []


def test_balls_spare_comparisons():
    """Far groups: most balls are wholly owned, few points are compared."""
    rng = np.random.default_rng(1)
    base = rng.integers(-100_000, 100_000, (40, 6))
    x = base[rng.integers(0, 40, 4_000)] + rng.integers(-50, 50, (4_000, 6))
    tree = metric_trees.tree_of(x)
    ordered = x[tree["order"]]
    _, points, _, compared = metric_trees.owned(tree, ordered, base)
    assert sorted(tree["order"].tolist()) == list(range(4_000))
    assert len(points) < 400 and compared < 0.02 * 4_000 * 40
    d = ((ordered[:, None, :] - base[None]) ** 2).sum(axis=2)
    assert (metric_trees.assigned(tree, ordered, base) == d.argmin(axis=1)).all()
    count, total = metric_trees.gathered(tree, ordered, base)
    own = d.argmin(axis=1)
    assert (count == np.bincount(own, minlength=40)).all() and all((total[e] == ordered[own == e].sum(axis=0)).all() for e in range(40))
