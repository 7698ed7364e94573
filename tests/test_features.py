import numpy as np
import pandas as pd
import pytest
from helpers import SPEC, by_id, difference, entropy, lag, make_series, own_mean, per_series, ratio, rolling, rows_of, season, stats, step

from tidewatch.functions import spectral as sp
from tidewatch.operators import features

BLOCKS = [None, 17]


def close(got, want, columns, tol=1e-7):
    for c in columns:
        a, b = got[c].to_numpy(float), want[c].to_numpy(float)
        assert np.array_equal(np.isnan(a), np.isnan(b)), c
        scale = np.maximum(1.0, np.abs(np.nan_to_num(b)))
        assert (np.abs(np.nan_to_num(a) - np.nan_to_num(b)) <= tol * scale).all(), c


def common(v, size):
    lags = {f"value_lag{k}": lag(v, k) for k in (1, 2, 3, 5, 10, 15)}
    out = dict(lags)
    out["first_diff"] = size(difference(v))
    out["second_diff"] = size(difference(out["first_diff"]))
    out["first_long_diff"] = size(lags["value_lag5"] - lags["value_lag1"])
    out["second_long_diff"] = size((lags["value_lag10"] - lags["value_lag5"]) - (lags["value_lag5"] - lags["value_lag1"]))
    out.update({f"value_lag{k}_ratio": ratio(lags[f"value_lag{k}"], lags["value_lag1"]) for k in (2, 3, 5, 10, 15)})
    return out


def set_a(v):
    out = common(v, lambda x: x)
    out.update({k: x for k, x in stats(v, fallback=False).items() if "entropy" not in k})
    out["first_ratio"] = step(v)
    out["second_diff_ratio"] = step(out["first_ratio"])
    out["first_long_ratio"] = ratio(out["value_lag5"], out["value_lag1"])
    return out


def set_c(v):
    out = common(v, np.abs)
    out.update(stats(v))
    out["first_diff_ratio"] = step(v)
    out["second_diff_ratio"] = step(out["first_diff_ratio"])
    out["value_ratio"] = own_mean(v)
    for s in ("std", "entropy", "mean"):
        out[f"value_w25_{s}_ratio"] = own_mean(out[f"value_w25_{s}"])
    return out


def set_b(v):
    out = stats(v)
    out["value_ratio"] = own_mean(v)
    for s in ("std", "entropy", "mean"):
        out[f"value_w50_{s}_ratio"] = own_mean(out[f"value_w50_{s}"])
    trend = v - out["value_w50_mean"]
    s = rolling(trend, 50, season)
    clean = trend - np.nan_to_num(s)
    out["value_trend_removed"], out["value_season_trend_removed"] = trend, clean
    out.update({k: x for k, x in stats(clean, "nom_").items() if k.endswith(("mean", "std"))})
    return out


@pytest.mark.parametrize("block", BLOCKS)
@pytest.mark.parametrize("fn,want", [(features.lag_features, set_a), (features.cluster_features, set_c), (features.seasonal_features, set_b)])
def test_feature_sets(spark, fn, want, block):
    pdf = make_series(1, sizes=(190, 60, 12, 3, 1))
    expect = per_series(pdf, want)
    got = by_id(fn(rows_of(spark, pdf), SPEC, block_rows=block))
    close(got, expect, [c for c in expect.columns if c not in pdf.columns])


def test_kurtosis_keeps_digits_far_from_the_centre(spark):
    pdf = make_series(3, sizes=(120,), zeros=False)
    pdf["value"] = pdf["value"] + np.where(pdf["t"] > 300, 1e6, 0.0)
    got = by_id(features.cluster_features(rows_of(spark, pdf), SPEC))
    want = stats(pdf["value"].to_numpy(float))
    late = got["t"] > 900
    assert np.allclose(got["value_w50_kurt"][late], want["value_w50_kurt"][late], atol=1e-4)


@pytest.mark.parametrize("block", BLOCKS)
def test_smoothing_mirrors_edges(spark, block):
    pdf = make_series(2)

    def smooth(v):
        k = np.exp(-0.5 * (np.arange(-12, 13) / 3.0) ** 2)
        k /= k.sum()
        out = []
        for i in range(len(v)):
            at = [(i + d) % (2 * len(v)) for d in range(-12, 13)]
            out.append(sum(w * v[a if a < len(v) else 2 * len(v) - 1 - a] for w, a in zip(k, at)))
        return {"smooth": np.array(out)}

    got = by_id(features.smooth(rows_of(spark, pdf), SPEC, 3.0, "smooth", block_rows=block))
    close(got, per_series(pdf, smooth), ["smooth"], 1e-10)


@pytest.mark.parametrize("block", [None, 4])
def test_peaks_take_the_middle_of_flat_tops(spark, block):
    v = [1, 3, 1, 2, 5, 5, 5, 2, 6, 6, 6, 6, 6, 6, 1, 7, 7, 9, 9]
    pdf = pd.DataFrame({"s": "a", "t": range(len(v)), "i": range(len(v)), "value": [float(x) for x in v]})
    got = by_id(features.with_peak_distance(rows_of(spark, pdf), SPEC, block_rows=block))
    # peaks at rows 1, 5 and 10; the last rise has no fall
    want, last = [], None
    for i in range(len(v)):
        last = i if i in (1, 5, 10) else last
        want.append(-1 if last is None else i - last)
    assert got["rows_since_peak"].tolist() == want


def test_no_peak_gives_minus_one(spark):
    pdf = pd.DataFrame({"s": "a", "t": range(6), "i": range(6), "value": [1.0, 2, 3, 4, 5, 6]})
    assert set(by_id(features.with_peak_distance(rows_of(spark, pdf), SPEC))["rows_since_peak"]) == {-1}


def test_window_callbacks(spark):
    pdf = make_series(4, sizes=(80,))
    v = pdf["value"].to_numpy(float)

    def residual(x):
        n, d = len(x), x - x.mean()
        r = np.array([(d[: n - k] * d[k:]).sum() / (x.var(ddof=1) * (n - k)) for k in range(1, (n + 1) // 2)])
        k = int(np.abs(r).argmax()) + 1
        return x[-1] - x[-k - 1] if abs(r[k - 1]) > 0.5 and k > 5 else x[-1]

    def wasserstein(x):
        tail, grid = x[-10:], np.sort(x)
        return sum(abs((x <= a).mean() - (tail <= a).mean()) * (b - a) for a, b in zip(grid, grid[1:]))

    rows = rows_of(spark, pdf)
    for fn, want in ((sp.autocorrelation_residual, residual), (sp.tail_wasserstein, wasserstein)):
        got = by_id(features.rolling_apply(rows, SPEC, 50, fn, "out"))["out"].to_numpy(float)
        expect = rolling(v, 50, want)
        assert np.isnan(got[:49]).all()
        assert np.allclose(got[49:], expect[49:])


def test_entropy_sentinels():
    assert entropy(np.array([1.0, -2.0, 3.0])) == 10000.0
    assert entropy(np.zeros(5)) == 10000.0
    assert np.isclose(entropy(np.array([-1.0, -1.0])), np.log(2))


def test_moments_keep_digits_beside_a_jump(spark):
    """Frames on both sides of a jump of 1e9, and across it."""
    pdf = make_series(5, sizes=(230,), zeros=False)
    pdf["value"] = pdf["value"] + np.where(pdf["t"] % 1500 > 700, 1e9, 0.0)
    got = by_id(features.cluster_features(rows_of(spark, pdf), SPEC))
    v = pdf["value"].to_numpy(float)
    near = v - np.where(pdf["t"] % 1500 > 700, 1e9, 0.0)
    want, calm = stats(v), stats(near)
    for n in (5, 25, 50):
        jump = rolling(v, n, np.ptp) > 1e8
        inside = ~jump & (np.arange(len(v)) >= n - 1)
        for k in ("std", "kurt", "zscore"):
            c = f"value_w{n}_{k}"
            assert np.allclose(got[c][inside], calm[c][inside], rtol=1e-5, atol=1e-5), c
            assert np.allclose(got[c][jump], want[c][jump], rtol=1e-7, atol=1e-7), c
