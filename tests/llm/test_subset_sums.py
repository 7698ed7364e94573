"""Hard negatives from subset-sum tables, against sorted inner products."""

import math

import numpy as np
import pytest

from tidewatch.llm import subset_sums
from tidewatch.llm.integers import LARGEST


def brute(rows, every=100, most_p=5, most_n=10, low=30, high=90):
    """rows: (id, vector, label)."""
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    width = max((len(r[1]) for r in ok), default=0)
    x = [[max(-LARGEST, min(LARGEST, math.floor(v * 256))) for v in r[1]] + [0] * (width - len(r[1])) for r in ok]
    out = []
    for a, (aid, _, label) in enumerate(ok):
        if aid % every:
            continue
        score = [sum(p * q for p, q in zip(x[a], y, strict=True)) for y in x]
        order = sorted((b for b in range(len(ok)) if b != a), key=lambda b: (-score[b], ok[b][0]))
        for p in [b for b in order if ok[b][2] == label][:most_p]:
            fits = [b for b in order if ok[b][2] != label and low * score[p] <= 100 * score[b] <= high * score[p]][:most_n]
            out += [(aid, ok[p][0], rank, ok[b][0], score[p], score[b]) for rank, b in enumerate(fits, 1)]
    return sorted(out)


def vectors(n, d, labels=4, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((labels, d)) * 0.2
    rows = []
    for i in range(n):
        label = 0 if i % 3 == 0 else i % labels  # a hot label
        rows.append((i, (base[i % labels] + rng.standard_normal(d) * 0.3).round(2).tolist(), label))
    return rows


def frame(spark, rows, label="int"):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], f"vec_id long, embedding array<double>, label {label}, uid string, rank string")


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("d,slot_rows", [(64, None), (13, 37), (1, 50), (8, 1000)])
def test_hard_negatives(spark, d, slot_rows):
    rows = vectors(350, d)
    want = brute(rows, every=25)
    assert want and got(subset_sums.hard_negatives(frame(spark, rows), every=25, slot_rows=slot_rows)) == want


def test_more_anchors_than_stand_together(spark):
    rows = vectors(120, 6)
    assert got(subset_sums.hard_negatives(frame(spark, rows), every=1, slot_rows=50)) == brute(rows, every=1)


def test_ties_missing_and_lengths(spark):
    rows = vectors(150, 8) + [(1000 + i, [0.5] * 8, i % 3) for i in range(40)]  # all scores of these are equal
    rows += [(5000, None, 1), (5001, [1.0, None], 1), (5002, [float("nan")] * 8, 1), (5003, [float("-inf")] * 8, 2), (None, [1.0] * 8, 1), (5004, [1.0] * 8, None)]
    rows += [(5100, [0.7, 0.3], 1), (5200, [], 2), (5300, [1e300, -1e300, 1e5], 1), (5400, [2e4, 3.5, -9e4], 1)]
    assert got(subset_sums.hard_negatives(frame(spark, rows), every=50)) == brute(rows, every=50)


def test_repeated_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 2), (1, [0.5, 0.5], 2), (2, [0.6, 0.0], 1)]
    out = got(subset_sums.hard_negatives(frame(spark, rows)))
    assert out == brute(rows) and sum(r[:2] == (0, 0) for r in out) == 4


def test_text_labels_and_empty(spark):
    rows = [(i, v, f"l{c}") for i, v, c in vectors(80, 8)]
    assert got(subset_sums.hard_negatives(frame(spark, rows, "string"), every=20)) == brute(rows, every=20)
    assert subset_sums.hard_negatives(frame(spark, [])).collect() == []


def test_lookups_are_exact():
    rng = np.random.default_rng(2)
    for low, high in ((-300, 300), (0, 1), (-1, 0), (0, 255), (-(2**25), 2**25)):
        x, a = rng.integers(low, high + 1, (200, 21)), rng.integers(low, high + 1, (9, 21))
        planes, n = subset_sums.planes_of(x)
        assert n <= 27
        assert (subset_sums.scores_of(planes, subset_sums.tables_of(a), slice(0, 200)) == x @ a.T).all()
