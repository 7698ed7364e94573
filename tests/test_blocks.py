"""Results must not depend on how a long series is cut."""

import numpy as np
import pandas as pd
import pytest
from helpers import SPEC, by_id, make_series, rows_of
from pyspark.sql import functions as F

from tidewatch import SeriesSpec, series, with_positions
from tidewatch.operators import encode, ordered, resample, seasonal, split, tolerance
from tidewatch.operators.embedding import history_windows, matrix_windows
from tidewatch.operators.quantiles import flag_above, quantiles
from tidewatch.series import fill_forward, series_stats, with_ordered_cuts

HOT = [None, 23]


@pytest.fixture(scope="module")
def pdf():
    return make_series(5, sizes=(240, 30, 3, 1))


@pytest.mark.parametrize("block", HOT)
def test_positions(spark, pdf, block):
    got = by_id(with_positions(rows_of(spark, pdf), SPEC, block_rows=block))
    assert got["_pos"].tolist() == pdf.groupby("s").cumcount().tolist()


@pytest.mark.parametrize("block", HOT)
def test_positions_without_key_and_with_timestamps(spark, pdf, block):
    rows = rows_of(spark, pdf).withColumn("ts", F.timestamp_seconds("i"))
    got = by_id(with_positions(rows, SeriesSpec((), ("ts",)), block_rows=block))
    assert got["_pos"].tolist() == list(range(len(pdf)))


def test_positions_with_equal_order_keys(spark):
    pdf = pd.DataFrame({"s": "a", "t": [1] * 50 + [2] * 50, "i": range(100), "value": 1.0})
    got = by_id(with_positions(rows_of(spark, pdf), SPEC, block_rows=10))
    assert got["_pos"].tolist() == list(range(100))


def test_cuts_stay_near_the_block_size_when_times_are_equal(spark):
    pdf = pd.DataFrame({"s": "a", "t": [5] * 1500 + list(range(10, 510)), "i": range(2000), "value": 1.0})
    rows = rows_of(spark, pdf)
    cut = with_ordered_cuts(rows, ["s"], SPEC.order, series_stats(rows, ["s"]), 100, "cut")
    sizes = [r["count"] for r in cut.groupBy("cut").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 200


def test_base_n_codes_of_text_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 50)
    names = [f"c{i:03d}" for i in range(300)]
    rows = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "c string, i int")
    got = by_id(encode.base_n_encode(rows, rows, "c", 2))
    digits = [c for c in got.columns if c.startswith("c_")]
    assert [int("".join(map(str, r)), 2) for r in got[digits].to_numpy().tolist()] == list(range(1, 301))


def test_null_series_key_is_a_series(spark):
    pdf = make_series(6, sizes=(40, 20))
    pdf.loc[pdf["s"] == "s0", "s"] = None
    got = by_id(with_positions(rows_of(spark, pdf), SPEC, block_rows=8))
    assert got["_pos"].tolist() == [*range(40), *range(20)]


@pytest.mark.parametrize("block", HOT)
@pytest.mark.parametrize("backward", [False, True])
def test_fill(spark, pdf, block, backward):
    x = pdf.copy()
    x["v"] = x["value"].where(np.random.default_rng(0).random(len(x)) < 0.05)
    got = by_id(fill_forward(rows_of(spark, x.astype({"v": object}).where(x.notna(), None)).withColumn("v", F.col("v").cast("double")), SPEC, {"f": F.col("v")}, backward, block_rows=block))
    want = x.groupby("s")["v"].bfill() if backward else x.groupby("s")["v"].ffill()
    assert np.allclose(got["f"].to_numpy(float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize("block", HOT)
@pytest.mark.parametrize("spec", [SPEC, SeriesSpec((), ("i",))])
def test_tolerant_adjustment(spark, pdf, block, spec):
    def want(y, p, slack=5):
        out = p.copy()
        for i in range(len(y)):
            if y[i] == p[i]:
                continue
            if p[i] == 1 and y[i - slack : i + slack].sum() > 0:
                out[i] = 0
            elif p[i] == 0 and p[i - slack : i + slack].sum() > 0:
                out[i] = 1
        return out

    got = by_id(tolerance.adjust_predictions(rows_of(spark, pdf), spec, "y", "p", block_rows=block))["adjusted"].tolist()
    groups = [g for _, g in pdf.groupby("s", sort=False)] if spec.series else [pdf]
    expect = np.concatenate([want(g["y"].to_numpy(), g["p"].to_numpy()) for g in groups])
    assert got == expect.tolist()


@pytest.mark.parametrize("block", HOT)
def test_batch_labels(spark, pdf, block):
    got = by_id(tolerance.batch_labels(rows_of(spark, pdf), SPEC, "y", block_rows=block))["batch_label"].tolist()
    want = []
    for _, g in pdf.groupby("s", sort=False):
        y = g["y"].tolist()
        want += [1 if i >= 20 and sum(y[i - 20 : i]) else 0 for i in range(len(y))]
    assert got == want


@pytest.mark.parametrize("block", HOT)
def test_global_index_and_folds(spark, pdf, block):
    rows = rows_of(spark, pdf)
    n = len(pdf)
    assert by_id(ordered.with_global_index(rows, SPEC, block_rows=block))["idx"].tolist() == list(range(n))
    got = by_id(split.contiguous_folds(rows, SPEC, 5, block_rows=block))["fold"].tolist()
    assert got == np.repeat(range(5), [len(a) for a in np.array_split(np.arange(n), 5)]).tolist()
    test = by_id(split.ordered_split(rows, SPEC, block_rows=block))["split"].tolist()
    assert test.count("test") == int(np.ceil(0.3 * n)) and test == sorted(test, reverse=True)


@pytest.mark.parametrize("block", HOT)
def test_history_windows(spark, block):
    # values 0..99 with labels 2x: the window before row i ends at i - 1
    pdf = pd.DataFrame({"s": "a", "t": range(100), "i": range(100), "value": np.arange(100.0), "y": np.arange(100) * 2})
    got = by_id(history_windows(rows_of(spark, pdf), SPEC, 20, "y", label_offset=-1, block_rows=block))
    assert got["i"].tolist() == list(range(20, 100))
    assert [list(w) for w in got["window"]] == [list(np.arange(i - 20, i, dtype=float)) for i in range(20, 100)]
    assert got["label"].tolist() == [2 * (i - 1) for i in range(20, 100)]


@pytest.mark.parametrize("block", HOT)
def test_matrix_windows(spark, pdf, block):
    got = by_id(matrix_windows(rows_of(spark, pdf), SPEC, ["value", "t"], 5, "y", block_rows=block))
    for _, g in pdf.groupby("s"):
        mine = got[got["s"] == g["s"].iloc[0]]
        assert len(mine) == max(0, len(g) - 5)
        for k, (_, r) in enumerate(mine.iterrows()):
            assert [list(x) for x in r["window"]] == g[["value", "t"]].to_numpy(float)[k : k + 5].tolist()
            assert r["window_label"] == g["y"].to_numpy()[k : k + 5].max()


@pytest.mark.parametrize("rows", [None, 20])
def test_quantiles(spark, pdf, rows):
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.999, "f": 1.0}
    got = quantiles(rows_of(spark, pdf), ["s"], "value", probs, group_rows=rows).toPandas().set_index("s")
    for s, g in pdf.groupby("s"):
        for n, p in probs.items():
            assert np.isclose(got.loc[s, n], np.percentile(g["value"], 100 * p)), (s, n)
    near = quantiles(rows_of(spark, pdf), [], "value", {"q": 0.97}, nearest=True, group_rows=rows).first()["q"]
    assert np.isclose(near, np.percentile(pdf["value"], 97, method="nearest"))


def test_quantile_of_one_dominant_value(spark):
    pdf = pd.DataFrame({"s": "a", "value": [5.0] * 900 + list(np.arange(100.0))})
    got = quantiles(spark.createDataFrame(pdf), ["s"], "value", {"m": 0.5, "h": 0.99}, group_rows=50).first()
    assert got["m"] == 5.0 and np.isclose(got["h"], np.percentile(pdf["value"], 99))


def test_flag_above_is_strict(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(101)], "score double")
    assert flag_above(rows, "score", 99.0).where("predicted = 1").count() == 1


@pytest.mark.parametrize("block", HOT)
def test_running_sums(spark, block):
    n = 150
    rows = spark.createDataFrame(pd.DataFrame({"o": np.random.default_rng(1).permutation(n).astype(float), "x": np.arange(n)}))
    got = ordered.running_sums(rows, "o", ["x"], block_rows=block).toPandas().sort_values("o")
    assert got["cum_x"].tolist() == got["x"].cumsum().tolist()


@pytest.mark.parametrize("block", HOT)
def test_hash_rank_is_a_permutation_and_does_not_depend_on_blocks(spark, pdf, block):
    got = by_id(ordered.hash_rank(rows_of(spark, pdf), ["y"], ["i"], 3, block_rows=block))
    base = by_id(ordered.hash_rank(rows_of(spark, pdf).repartition(3), ["y"], ["i"], 3))
    assert got["rank"].tolist() == base["rank"].tolist()
    for _, g in got.groupby("y"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))


@pytest.mark.parametrize("block", HOT)
def test_interpolation_by_time(spark, block):
    t = pd.to_datetime(np.cumsum(np.random.default_rng(2).integers(1, 50, 60)), unit="s")
    v = pd.Series(np.random.default_rng(3).normal(size=60), index=t)
    v[np.random.default_rng(4).random(60) < 0.6] = np.nan
    v.iloc[:3] = np.nan
    pdf = pd.DataFrame({"datetime": t, "v": v.to_numpy()})
    rows = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None)))
    got = resample.interpolate_by_time(rows, ["v"], block_rows=block).toPandas().sort_values("datetime")
    assert np.allclose(got["v"].to_numpy(float), v.interpolate(method="time").to_numpy(), equal_nan=True)


@pytest.mark.parametrize("block", HOT)
def test_autocorrelation_and_decomposition(spark, block):
    n = 144
    v = 5 * np.sin(np.arange(n) * 2 * np.pi / 12) + 0.05 * np.arange(n) + np.random.default_rng(5).normal(0, 0.3, n)
    pdf = pd.DataFrame({"s": "a", "t": range(n), "i": range(n), "value": v})
    rows = rows_of(spark, pdf)
    found = seasonal.period(rows, SPEC, block_rows=block).first()
    d = v - v.mean()
    r = [(d[: n - k] * d[k:]).sum() / (v.var(ddof=1) * (n - k)) for k in range(1, 72)]
    acf = seasonal.autocorrelation(rows, SPEC, block_rows=block).toPandas().sort_values("lag")
    assert acf["lag"].tolist() == list(range(1, 72)) and np.allclose(acf["r"], r)
    k = int(np.abs(r).argmax()) + 1
    assert found["lag"] == k and np.isclose(found["r"], r[k - 1])
    got = by_id(seasonal.decompose(rows, SPEC, 12, block_rows=block))
    weights = np.array([0.5] + [1] * 11 + [0.5]) / 12
    trend = np.full(n, np.nan)
    trend[6 : n - 6] = np.convolve(v, weights, "valid")
    phase = np.array([np.nanmean((v - trend)[i::12]) for i in range(12)])
    phase -= phase.mean()
    assert np.allclose(got["residual"].to_numpy(float), v - trend - phase[np.arange(n) % 12], equal_nan=True)
    flat = by_id(seasonal.remove_seasonality(rows, SPEC, block_rows=block))
    if k == 12:
        assert np.allclose(flat["value"].to_numpy(float), v - trend - phase[np.arange(n) % 12], equal_nan=True)
    else:
        assert np.nanstd(flat["value"].to_numpy(float)) < 1.0 < v.std()


@pytest.mark.parametrize("block", HOT)
def test_spectrum(spark, block):
    rows = seasonal.sine(spark, 200, [20.0, 50.0], 2.0).selectExpr("'a' AS s", "ts AS t", "ts AS i", "value")
    bins = seasonal.strongest_bins(seasonal.spectrum(rows, SPEC, block_rows=block), SPEC, 2)
    assert sorted((r["bin"], r["period"]) for r in bins.collect()) == [(4, 50), (10, 20)]
    rest = seasonal.remove_bins(rows, SPEC, bins, block_rows=block).toPandas()["filtered"]
    assert np.abs(rest).max() < 1e-8


@pytest.mark.parametrize("n", [1, 2, 7, 64, 97])
def test_all_bins_of_any_length(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    rows = spark.createDataFrame(pd.DataFrame({"s": "a", "t": range(n), "i": range(n), "value": v}))
    got = seasonal.spectrum(rows, SPEC).toPandas().sort_values("bin")
    want = np.fft.rfft(v)[1:]
    assert got["bin"].tolist() == list(range(1, n // 2 + 1))
    assert np.allclose(got["re"], want.real) and np.allclose(got["im"], -want.imag)


@pytest.mark.parametrize("block", HOT)
def test_threshold_sweep(spark, pdf, block):
    x = pdf.copy()
    x["score"] = np.round(np.random.default_rng(9).random(len(x)), 2)
    got = tolerance.threshold_sweep(rows_of(spark, x), SPEC, "y", "score", slack=5, block_rows=block).toPandas().set_index("threshold")
    for cut in (50, 73, 99):
        tp = fp = fn = 0
        for _, g in x.groupby("s"):
            y, p = g["y"].to_numpy(), (g["score"].to_numpy() >= cut / 100).astype(int)
            for i in range(len(y)):
                a = p[i]
                if p[i] == 1 and y[i] == 0 and y[i - 5 : i + 5].sum() > 0:
                    a = 0
                elif p[i] == 0 and y[i] == 1 and p[i - 5 : i + 5].sum() > 0:
                    a = 1
                tp, fp, fn = tp + (a & y[i]), fp + (a & (1 - y[i])), fn + ((1 - a) & y[i])
        assert np.isclose(got.loc[cut, "precision"], tp / (tp + fp) if tp + fp else 0)
        assert np.isclose(got.loc[cut, "recall"], tp / (tp + fn) if tp + fn else 0)


@pytest.mark.parametrize("block", HOT)
def test_whole_table_as_one_series(spark, pdf, block):
    from tidewatch.operators import features, normalize

    spec = SeriesSpec((), ("i",))
    rows = rows_of(spark, pdf)
    got = by_id(features.smooth(rows, spec, 1.0, "smooth", block_rows=block))
    v = pdf["value"].to_numpy(float)
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    want = np.convolve(np.r_[v[3::-1], v, v[:-5:-1]], k / k.sum(), "valid")
    assert np.allclose(got["smooth"], want)
    scaled = by_id(normalize.by_percentile(rows, spec, 90))["value"]
    assert np.allclose(scaled, v / np.percentile(v, 90))
    parts = by_id(seasonal.decompose(rows, spec, 5, block_rows=block))
    trend = np.r_[[np.nan] * 2, np.convolve(v, np.ones(5) / 5, "valid"), [np.nan] * 2]
    assert np.allclose(parts["trend"].to_numpy(float), trend, equal_nan=True)


@pytest.mark.parametrize("nearest", [False, True])
def test_quantiles_from_a_poor_sketch(spark, nearest):
    """Brackets that miss their rank, or hold far too many values, are moved and halved until they fit."""
    rng = np.random.default_rng(6)
    skew = np.exp(rng.standard_normal(4_000) * 3)
    ties = np.repeat([1.0, 2.0, 5.0], [2_500, 3, 40])
    pdf = pd.DataFrame({"s": ["a"] * len(skew) + ["b"] * len(ties) + ["c"] * 7, "value": np.concatenate([skew, ties, np.arange(7.0)])})
    probs = {"p0": 0.0, "p1": 0.013, "p50": 0.5, "p97": 0.97, "p999": 0.999, "p100": 1.0}
    df = spark.createDataFrame(pdf).repartition(4)
    for accuracy, rows in ((10, 60), (2, 500), (1, 20)):
        got = quantiles(df, ["s"], "value", probs, nearest=nearest, group_rows=rows, accuracy=accuracy).toPandas().set_index("s")
        for s, part in pdf.groupby("s"):
            v = np.sort(part["value"].to_numpy())
            for name, p in probs.items():
                want = v[int(np.round((len(v) - 1) * p))] if nearest else np.percentile(v, 100 * p)
                assert np.isclose(got.loc[s, name], want, rtol=1e-12), (s, name, accuracy)


def test_quantiles_without_keys_or_rows(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(300)], "k int, value double")
    assert quantiles(df, [], "value", {"m": 0.5}, group_rows=10, accuracy=3).first()["m"] == 149.5
    assert quantiles(df.where("k = 2"), ["k"], "value", {"m": 0.5}, nearest=True).collect() == []
