"""Hand-made series and brute-force versions of the row rules, in plain numpy and pandas."""

import numpy as np
import pandas as pd

from tidewatch import SeriesSpec

SPEC = SeriesSpec(("s",), ("t", "i"))


def make_series(seed=0, sizes=(130, 60, 12, 3, 1), zeros=True):
    rng = np.random.default_rng(seed)
    parts = []
    for n, size in enumerate(sizes):
        v = np.round(rng.normal(20, 6, size), 3)
        if zeros and size > 20:
            v[rng.integers(0, size, 4)] = 0.0
            v[5:11] = 7.0  # a constant stretch
        parts.append(pd.DataFrame({"s": f"s{n}", "t": np.arange(size) * 10, "value": v, "y": (rng.random(size) < 0.1).astype(int), "p": (rng.random(size) < 0.15).astype(int)}))
    out = pd.concat(parts, ignore_index=True)
    out["i"] = np.arange(len(out))
    return out


def rows_of(spark, pdf):
    return spark.createDataFrame(pdf.sample(frac=1.0, random_state=1))


def by_id(df, key="i"):
    return df.toPandas().sort_values(key).reset_index(drop=True)


def entropy(w):
    total = w.sum()
    if total == 0:
        return 10000.0
    p = w / total
    if (p < 0).any():
        return 10000.0
    p = p[p > 0]
    return float(-(p * np.log(p)).sum())


def kurtosis(w):
    n, m = len(w), w.mean()
    var = ((w - m) ** 2).mean()
    if np.ptp(w) == 0:
        return np.nan
    g = ((w - m) ** 4).mean() / var**2 - 3
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6)


def zscore(w):
    sd = w.std()
    return np.nan if np.ptp(w) == 0 else (w[-1] - w.mean()) / sd


STAT = {"mean": np.mean, "std": lambda w: w.std(ddof=1), "kurt": kurtosis, "zscore": zscore, "entropy": entropy}


def season(w):
    f = np.fft.fft(w)
    j = int(np.argmax(np.abs(f[1:26]))) + 1
    keep = np.zeros(len(w), dtype=complex)
    keep[len(w) - j] = f[len(w) - j]
    return float(np.fft.ifft(keep)[-1].real)


def rolling(v, n, fn):
    return np.array([fn(v[i - n + 1 : i + 1]) if i >= n - 1 else np.nan for i in range(len(v))])


def stats(v, prefix="", fallback=True):
    out, last = {}, {"mean": v, "std": v * 0, "kurt": v * 0, "zscore": v * 0, "entropy": v * 0}
    for n in (5, 25, 50):
        now = {}
        for k, fn in STAT.items():
            x = rolling(v, n, fn)
            now[k] = np.where(np.isnan(x), last[k], x) if fallback else x
            out[f"{prefix}value_w{n}_{k}"] = now[k]
        last = now
    return out


def ratio(a, b):
    return np.array([x / y if not np.isnan(y) and y != 0 else 1000.0 for x, y in zip(a, b)])


def own_mean(c):
    return ratio(c, rolling(c, 10, np.mean))


def difference(v):
    return np.array([v[i] - v[i - 1] if i > 1 else 0.0 for i in range(len(v))])


def step(v):
    return np.array([v[i] / v[i - 1] if i > 1 and v[i - 1] > 0 else 1000.0 for i in range(len(v))])


def lag(v, k):
    return np.array([v[i - k] if i >= k else 0.0 for i in range(len(v))])


def per_series(pdf, fn):
    return pd.concat([g.assign(**fn(g["value"].to_numpy(float))) for _, g in pdf.groupby("s", sort=False)]).sort_values("i").reset_index(drop=True)
