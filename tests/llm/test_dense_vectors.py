"""Recall of the projection passes: their number, and vectors that lie densely."""

import numpy as np

from tidewatch.llm import projections


def test_passes_bound_the_miss_rate():
    for n in (10, 2_000, 100_000, 6_000_000, 400_000_000, 10**11):
        k, passes = projections.leading_hashes(n, 24), projections.passes_for(n, 24)
        assert 24 * 64**k >= n and passes >= 16 and (1 - projections.AGREE**k) ** passes <= projections.MISS


def cone(n, pairs):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(64)
    base /= np.linalg.norm(base)

    def off(x, cos):
        z = rng.standard_normal(64)
        z -= (z @ x) * x
        return cos * x + np.sqrt(1 - cos**2) * z / np.linalg.norm(z)

    rows = [off(base, 0.8) for _ in range(n)]
    return rows + [off(rows[i], 0.92) for i in range(pairs)]


def test_pairs_in_a_dense_cone(spark):
    """Near pairs in one cone whose other members are no links: runs far longer than a window."""
    rows = cone(3_000, 150)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in projections.near_vectors(df).collect()}
    x = np.array(rows)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(got.values()) >= 0.98 * near.sum() > 0
