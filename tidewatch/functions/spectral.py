"""Arrow-batched window functions that have no built-in expression: array<double> -> double."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOWEST_BIN = 1


def _by_length(frames: pd.Series, fn) -> pd.Series:
    """Apply ``fn(matrix) -> vector`` to the non-null arrays, one matrix per array length."""
    out = np.full(len(frames), np.nan)
    lengths = np.array([-1 if f is None else len(f) for f in frames])
    for n in np.unique(lengths[lengths > 0]):
        idx = np.flatnonzero(lengths == n)
        out[idx] = fn(np.stack([np.asarray(frames.iloc[i], dtype=float) for i in idx]))
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


def _strongest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the strongest non-constant frequency and its coefficient, per row."""
    spectrum = np.fft.rfft(x, axis=1)[:, LOWEST_BIN:]
    j = np.argmax(np.abs(spectrum), axis=1)
    return j + LOWEST_BIN, spectrum[np.arange(len(x)), j]


def _wave(x: np.ndarray) -> np.ndarray:
    """Real part of the strongest single frequency over the whole window, one row per window."""
    n = x.shape[1]
    j, coefficient = _strongest(x)
    t = np.arange(n)
    return (coefficient[:, None] * np.exp(2j * np.pi * j[:, None] * t[None, :] / n)).real / n


def _vectorised(fn):
    """A pandas UDF from ``fn(matrix of equally long windows) -> vector``."""

    def run(frames: pd.Series) -> pd.Series:
        return _by_length(frames, fn)

    run.__annotations__ = {"frames": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")


def seasonal_last(frame: Column) -> Column:
    return _vectorised(lambda x: _wave(x)[:, -1])(frame)


def seasonal_ratio(frame: Column) -> Column:
    """Last seasonal value over the median of the seasonal window; 10000 when the median is 0.

    A median within rounding of 0 (most waves are symmetric) counts as 0.
    """

    def fn(x: np.ndarray) -> np.ndarray:
        wave = _wave(x)
        mid = np.median(wave, axis=1)
        zero = np.abs(mid) <= 1e-9 * np.abs(wave).max(axis=1)
        return np.where(zero, 10000.0, wave[:, -1] / np.where(zero, 1.0, mid))

    return _vectorised(fn)(frame)


def autocorrelation_residual(frame: Column) -> Column:
    """x[last] - x[last - lag] when the strongest autocorrelation exceeds .5 at a lag above 5, else x[last]."""

    def fn(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        norm = x - x.mean(axis=1, keepdims=True)
        var = x.var(axis=1, ddof=1)
        lags = np.arange(1, (n + 1) // 2)
        r = np.stack([(norm[:, : n - k] * norm[:, k:]).sum(axis=1) / (n - k) for k in lags], axis=1)
        r = np.divide(r, var[:, None], out=np.zeros_like(r), where=var[:, None] > 0)
        best = np.argmax(np.abs(r), axis=1)
        lag = lags[best]
        strong = (np.abs(r[np.arange(len(x)), best]) > 0.5) & (lag > 5)
        return np.where(strong, x[:, -1] - x[np.arange(len(x)), n - 1 - lag], x[:, -1])

    return _vectorised(fn)(frame)


def tail_wasserstein(frame: Column, tail: int = 10) -> Column:
    """Distance between the distribution of the window and of its last ``tail`` values."""

    def fn(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        order = np.argsort(x, axis=1, kind="stable")
        ordered = np.take_along_axis(x, order, axis=1)
        share_all = np.arange(1, n) / n
        share_tail = np.cumsum(order >= n - tail, axis=1)[:, :-1] / tail
        return (np.abs(share_all[None, :] - share_tail) * np.diff(ordered, axis=1)).sum(axis=1)

    return _vectorised(fn)(frame)
