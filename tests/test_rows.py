"""Evaluation, neighbours, balancing, encoders and profiles against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import balance, detect, encode, evaluate, metrics_query, neighbors, profile, resample, split


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(300) < 0.3).astype(int)
    s = np.round(np.clip(0.3 * y + rng.random(300) * 0.7, 0, 1), 2)
    return pd.DataFrame({"id": range(300), "y": y, "score": s, "p": (s > 0.5).astype(int)})


def test_scores_and_auc(spark, scored):
    rows = spark.createDataFrame(scored)
    got = evaluate.evaluate(rows, "y", "p").first()
    y, p, s = (scored[c].to_numpy() for c in ("y", "p", "score"))
    tp, fp, fn, tn = ((p & y).sum(), (p & (1 - y)).sum(), ((1 - p) & y).sum(), ((1 - p) & (1 - y)).sum())
    assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (tp, fp, fn, tn)
    assert np.isclose(got["f1"], 2 * tp / (2 * tp + fp + fn))
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    for block in (None, 10):
        assert np.isclose(evaluate.roc_auc(rows, "y", "score", block_rows=block).first()[0], want)
    cuts = sorted(set(s), reverse=True)
    points = [((s >= c) & (y == 1)).sum() for c in cuts], [(s >= c).sum() for c in cuts]
    recall = np.array([0, *points[0]]) / y.sum()
    precision = np.array([1.0, *(np.array(points[0]) / np.array(points[1]))])
    areas = evaluate.precision_recall_areas(rows, "y", "score", block_rows=10).first()
    assert np.isclose(areas["pr_auc"], np.trapezoid(precision, recall))
    assert np.isclose(areas["average_precision"], (np.diff(recall) * precision[1:]).sum())


def test_one_class_gives_zero_auc(spark):
    rows = spark.createDataFrame([(0, 0.2, 0), (0, 0.4, 1)], "y int, score double, p int")
    assert evaluate.roc_auc(rows, "y", "score").first()[0] == 0.0
    assert evaluate.evaluate(rows, "y", "p").first()["auc"] == 0.0


def test_median_vote_rounds_half_to_even(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (1.0, 2.0), (1.0, 1.0)], "a double, b double")
    assert [r["ensemble"] for r in evaluate.median_vote(rows, ["a", "b"]).collect()] == [0.0, 2.0, 1.0]


@pytest.mark.parametrize("pivots,block", [(1, 20_000), (9, 15), (40, 7)])
def test_nearest_is_exact(spark, pivots, block):
    rng = np.random.default_rng(pivots)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), np.tile(rng.normal(0, 1, 3), (80, 1)), rng.normal(9, 0.1, (40, 3))])
    pdf = pd.DataFrame({"id": range(len(x)), "v": [list(map(float, r)) for r in x]})
    rows = spark.createDataFrame(pdf)
    got = neighbors.nearest(rows, rows, "id", "id", "v", "v", 4, exclude_same=True, pivots=pivots, block=block).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for i, g in got.groupby("id"):
        order = np.lexsort((np.arange(len(x)), d[i]))[:4]
        assert np.allclose(g.sort_values("rank")["distance"], d[i][order])
        assert g.sort_values("rank")["near_id"].tolist() == order.tolist()
    assert got["id"].nunique() == len(x)


def test_synthetic_rows_lie_between_minority_rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(400), "a": rng.normal(0, 1, 400), "y": ([1] * 12 + [0] * 388)})
    rows = spark.createDataFrame(pdf)
    out = balance.smote_undersample(rows, "y", "id", ["a"], seed=4).toPandas()
    assert (out["synthetic"] == 1).sum() == 38 - 12 and (out["y"] == 0).sum() == 76
    lo, hi = pdf.loc[pdf["y"] == 1, "a"].agg(["min", "max"])
    assert out.loc[out["synthetic"] == 1, "a"].between(lo, hi).all()
    again = balance.smote_undersample(rows.repartition(5), "y", "id", ["a"], seed=4).toPandas()
    key = ["id", "a", "y", "synthetic"]
    assert np.allclose(out.sort_values(key)[key], again.sort_values(key)[key])


def test_alternating_batch(spark, scored):
    got = balance.alternating_batch(spark.createDataFrame(scored), "y", ["id"], 64).toPandas()
    assert sorted(got["slot"]) == list(range(64)) and (got["slot"] % 2 == got["y"]).all()


def test_series_folds(spark):
    cats = [0] * 8 + [1] * 4 + [2] * 3 + [0] * 2
    pdf = pd.DataFrame({"s": [f"s{i}" for i in range(17)], "c": cats, "o": range(17)})
    got = split.stratified_series_folds(spark.createDataFrame(pdf), "s", "c", "o", 5).toPandas().sort_values("o")["fold"].to_numpy()
    # deal the category-sorted list in turn, then hand out inside each category in order
    ordered = np.sort(cats)
    want = np.empty(17, dtype=int)
    for c in set(cats):
        dealt = [sum(1 for g in range(f, 17, 5) if ordered[g] == c) for f in range(5)]
        want[np.array(cats) == c] = np.repeat(range(5), dealt)
    assert got.tolist() == want.tolist()


def test_encoders(spark):
    train = spark.createDataFrame([("a", 1, 1.0), ("a", 0, 3.0), ("b", 0, 5.0), ("c", 1, 7.0)], "c string, y int, x double")
    test = spark.createDataFrame([("a", 2.0), ("z", 1.0)], "c string, x double")
    got = {r["x"]: r["c"] for r in encode.target_encode(train, test, "c", "y", prior_rows=2.0).collect()}
    assert np.isclose(got[2.0], (1 + 0.5 * 2) / 4) and got[1.0] == 0.0
    none = encode.target_encode(train.where("x > 99"), test, "c", "y").collect()
    assert [r["c"] for r in none] == [0.0, 0.0]
    diff = {r["x"]: r["c_cat_diff"] for r in encode.category_difference(train, test, "c", "x").collect()}
    assert diff == {2.0: 0.0, 1.0: None}
    hot = encode.one_hot(train, train, "c").toPandas()
    assert [c for c in hot.columns if c.startswith("c_")] == ["c_b", "c_c"] and "c" not in hot
    with pytest.raises(ValueError):
        encode.one_hot(train, test, "c")
    rare = {r["x"]: r["c"] for r in encode.replace_rare(train, test, "c", "x", 0.3).collect()}
    assert rare == {2.0: "a", 1.0: None}
    hashed = encode.hash_encode(train, ["c"], 8).toPandas()
    assert (hashed[[f"col_{i}" for i in range(8)]].sum(axis=1) == 1).all()
    base = encode.base_n_encode(train, train, "c", 2).toPandas().sort_values("x")
    assert base[["c_0", "c_1"]].to_numpy().tolist() == [[0, 1], [0, 1], [1, 0], [1, 1]]


def test_metric_gate_and_rounding(spark):
    ts = F.to_timestamp(F.lit("2024-01-01 00:00:05"))
    one = spark.range(1).select(resample.round_time(ts).alias("a"), resample.round_time(ts + F.expr("INTERVAL 10 SECONDS")).alias("b")).first()
    assert (one["a"].second, one["b"].second) == (0, 20)
    m = spark.createDataFrame([("a", "1", None)] * 3 + [("b", "1", 1.0)] * 3 + [("c", "1", 1.0)] * 12, "app_id string, version string, throughput double")
    apps = spark.createDataFrame([(x, "1") for x in "abcd"], "app_id string, version string")
    got = {r["app_id"]: r["reason"] for r in metrics_query.suitability(m, apps).collect()}
    assert got == {"a": "no_throughput", "b": "too_few_rows", "c": "suitable", "d": "empty"}


def test_bound_values_are_not_sql(spark):
    rows = spark.createDataFrame([("x' OR '1'='1", "b"), ("a", "b")], "first string, last string")
    assert metrics_query.count_matching(rows, first="a' OR '1'='1", last="b").first()["n"] == 0
    assert metrics_query.count_matching(rows, first="x' OR '1'='1", last="b").first()["n"] == 1


def test_profiles(spark):
    rows = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), "x"), (3, -2.5, "y")], "id int, v double, w string")
    got = profile.null_profile(rows, ["v", "w"]).first()
    assert (got["null_rows"], got["null_columns"], got["found"]) == (2, "v,w", True)
    assert sorted((r["id"], r["column"]) for r in profile.null_positions(rows, "id", ["v", "w"]).collect()) == [(1, "w"), (2, "v")]
    text = profile.column_ranges(spark.createDataFrame([("m", -2.345), ("m", 1.0)], "k string, v double"), ["k"], ["v"]).first()["text"]
    assert text.startswith("-2.3") and text.endswith("-1.0")


def test_cluster_detector_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"value": np.r_[rng.normal(0, 1, 300), rng.normal(20, 1, 300), 60.0], "n": 0.0})
    rows = spark.createDataFrame(pdf)
    d = detect.ClusterDetector.fit(rows.where("value < 50"), ["value", "n"], 2)
    flags = d.transform(rows)
    assert flags.where("value = 60 AND predicted = 1").count() == 1
    assert 4 <= flags.where("value < 50 AND predicted = 1").count() <= 8
    d.save(spark, str(tmp_path / "m"))
    back = detect.ClusterDetector.load(spark, str(tmp_path / "m"))
    assert back == d
    assert back.transform(rows).exceptAll(flags).count() == 0


def test_isolation_scores_rank_the_outlier_first(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": range(501), "a": np.r_[rng.normal(0, 1, 500), 15.0], "b": np.r_[rng.normal(0, 1, 500), -15.0]})
    rows = spark.createDataFrame(pdf)
    got = detect.isolation_forest(rows, ["id"], ["a", "b"], trees=20, samples=25).predict(rows, 0.03).toPandas()
    assert got.sort_values("score").iloc[-1]["id"] == 500
    assert got["predicted"].sum() <= 0.03 * 501 + 1


def test_reconstruction_scores_flag_the_odd_window(spark):
    t = np.linspace(0, 1, 6)
    rows = [([float(a * x) for x in t], a) for a in range(1, 60)] + [([0.0, 9.0, 0.0, 9.0, 0.0, 9.0], -1)]
    df = spark.createDataFrame(rows, "vector array<double>, a int")
    out = detect.reconstruction_scores(df.where("a > 0"), df, "vector", 2)
    assert out.orderBy(F.desc("score")).first()["a"] == -1


def test_normal_windows_are_split_and_attack_windows_are_test(spark):
    from tidewatch.operators import split
    from tidewatch.series import SeriesSpec

    labels = [0, 1, 0, 0, None, 0, 1, 0, 0, 0, 0, 0, 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "i long, window_label int")
    got = {r.i: r.split for r in split.normal_window_split(df, SeriesSpec((), ("i",), "")).collect()}
    normal = [i for i, v in enumerate(labels) if not v]
    assert [got[i] for i in normal] == ["train"] * 4 + ["validation"] + ["test"] * 5
    assert all(got[i] == "test" for i, v in enumerate(labels) if v)
    assert split.normal_window_split(df.where("false"), SeriesSpec((), ("i",), "")).count() == 0


def test_blocks_of_neighbours_grow_with_the_table(spark, monkeypatch):
    assert neighbors.block_rows(2_000, 64, 6) == neighbors.BLOCK  # small tables keep their tasks
    assert neighbors.block_rows(600_000, 64, 6) > 9 * neighbors.BLOCK and neighbors.block_rows(10**9, 64, 6) * 64 * 8 <= neighbors.BLOCK_BYTES
    assert neighbors.block_rows(60_000, 64, 200) == neighbors.BLOCK  # many cores get their tasks
    assert neighbors._joined(np.array([3, 4, 5, 9, 1]), 9).tolist() == [0, 0, 1, 2, 3]
    stored = []
    monkeypatch.setattr(neighbors, "written", lambda df, f=neighbors.written: stored.append(f(df)) or stored[-1])
    monkeypatch.setattr(neighbors, "BLOCK", 40)
    monkeypatch.setattr(neighbors, "SIDE_BLOCKS", 2)
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(700, 5)), 1).astype(np.float32)  # single digits, and many ties
    rows = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "id long, v array<float>")
    got = neighbors.nearest(rows, rows, "id", "id", "v", "v", 3, exclude_same=True, pivots=4).toPandas().sort_values(["id", "rank"])
    d = neighbors._distances(v.astype(float), v.astype(float))
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert got["near_id"].tolist() == want.ravel().tolist()
    assert np.allclose(got["distance"], np.take_along_axis(d, want, axis=1).ravel(), rtol=0, atol=1e-12)
    assert [s.count() for s in stored] == [700, 700]  # no vector is stored once per cell
    assert all("array<float>" in dict(s.dtypes).values() for s in stored)


def test_strips_bound_the_nearest_ones():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 6)), np.round(rng.normal(size=(3_000, 6)), 1)
    skip = rng.random((30, 3_000)) < 0.3
    qi, ti, dist = neighbors._close_pairs(x, y, 5, skip)
    d = np.where(skip, np.inf, neighbors._distances(x, y))
    for q in range(30):
        own = np.sort(dist[qi == q])[:5]
        assert np.allclose(own, np.sort(d[q])[:5], rtol=0, atol=1e-12)
        last = own[-1]
        assert set(ti[(qi == q) & (dist <= last)]) == set(np.flatnonzero(d[q] <= last))
