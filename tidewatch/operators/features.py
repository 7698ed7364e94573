"""Feature sets over one measured column of a series."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions import frames as fr
from tidewatch.functions.scalars import safe_ratio
from tidewatch.functions.spectral import seasonal_last
from tidewatch.series import POS, TOTAL, SeriesSpec, fill_forward, over_series, series_stats

SEASON_WINDOW = 50


def _rename_value(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return df if spec.value == "value" else df.withColumnRenamed(spec.value, "value")


def _row_windows(w: WindowSpec, size) -> dict[str, Column]:
    """First-level windows of sets A and C: lags, step difference, step ratio, frame aggregates."""
    v = F.col("value")
    out = {f"value_lag{i}": fr.lag_or_zero(v, w, i) for i in fr.LAGS}
    out["first_diff"] = size(fr.step_difference(v, w))
    out["_step_ratio"] = fr.step_ratio(v, w)
    out["_mean10"] = fr.rolling_mean(v, w, fr.RATIO_WINDOW)
    out.update(fr.base_stat_windows("value", w))
    return out


def _row_expressions(size) -> dict[str, Column]:
    l1, l5, l10 = F.col("value_lag1"), F.col("value_lag5"), F.col("value_lag10")
    out = {
        "first_long_diff": size(l5 - l1),
        "second_long_diff": size((l10 - l5) - (l5 - l1)),
    }
    out.update({f"value_lag{i}_ratio": safe_ratio(F.col(f"value_lag{i}"), l1) for i in fr.RATIO_LAGS})
    return out


def lag_features(df: DataFrame, spec: SeriesSpec, **kw) -> DataFrame:
    """Set A: lags, signed differences, rolling statistics without fallback, ratios."""

    def fn(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = fr.with_references(rows, w, "value")
        rows = rows.withColumns(_row_windows(w, lambda c: c)).withColumnRenamed("_step_ratio", "first_ratio")
        stats = fr.base_stats("value", fallback=False, entropy=False)
        rows = rows.withColumns({**_row_expressions(lambda c: c), **stats})
        return rows.withColumns(
            {
                "second_diff": fr.step_difference(F.col("first_diff"), w),
                "second_diff_ratio": fr.step_ratio(F.col("first_ratio"), w),
                "first_long_ratio": safe_ratio(F.col("value_lag5"), F.col("value_lag1")),
            }
        ).drop("_mean10", *fr.helper_names())

    return over_series(_rename_value(df, spec), spec, fn, before=max(fr.WINDOWS), **kw)


def seasonal_features(df: DataFrame, spec: SeriesSpec, **kw) -> DataFrame:
    """Set B: statistics with fallback, ratios to own mean, and the same after trend and season removal."""

    def fn(rows: DataFrame, w: WindowSpec) -> DataFrame:
        v = F.col("value")
        rows = fr.with_references(rows, w, "value")
        rows = rows.withColumns(
            {**fr.base_stat_windows("value", w), "value_ratio": fr.ratio_to_own_mean(v, w)}
        )
        rows = rows.withColumns(fr.base_stats("value")).drop(*fr.helper_names())
        rows = rows.withColumn("value_trend_removed", v - F.col("value_w50_mean"))
        stats = ("std", "kurt", "entropy", "zscore", "mean")
        rows = rows.withColumns(
            {
                **{f"value_w50_{s}_ratio": fr.ratio_to_own_mean(F.col(f"value_w50_{s}"), w) for s in stats},
                "_frame": full_frame("value_trend_removed", w, SEASON_WINDOW),
            }
        )
        season = F.coalesce(seasonal_last(F.col("_frame")), F.lit(0.0))
        rows = rows.withColumn("value_season_trend_removed", F.col("value_trend_removed") - season).drop("_frame")
        rows = fr.with_references(rows, w, "value_season_trend_removed")
        rows = rows.withColumns(fr.base_stat_windows("value_season_trend_removed", w))
        rows = rows.withColumns(fr.base_stats("value_season_trend_removed", prefix="nom_"))
        nom = {f"nom_value_w50_{s}_ratio": f"nom_value_w50_{s}" for s in ("std", "kurt", "entropy")}
        return rows.withColumns({k: fr.ratio_to_own_mean(F.col(c), w) for k, c in nom.items()}).drop(
            *fr.helper_names()
        )

    reach = 3 * (SEASON_WINDOW - 1) + fr.RATIO_WINDOW
    return over_series(_rename_value(df, spec), spec, fn, before=reach, **kw)


def cluster_features(df: DataFrame, spec: SeriesSpec, **kw) -> DataFrame:
    """Set C: lags, absolute differences, statistics with fallback, ratios (w25 own means)."""

    def fn(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = fr.with_references(rows, w, "value")
        rows = rows.withColumns(_row_windows(w, F.abs)).withColumnRenamed("_step_ratio", "first_diff_ratio")
        rows = rows.withColumns({**_row_expressions(F.abs), **fr.base_stats("value")}).drop(*fr.helper_names())
        stats = ("std", "kurt", "entropy", "zscore", "mean")
        return rows.withColumns(
            {
                "second_diff": F.abs(fr.step_difference(F.col("first_diff"), w)),
                "value_ratio": safe_ratio(F.col("value"), F.col("_mean10")),
                "second_diff_ratio": fr.step_ratio(F.col("first_diff_ratio"), w),
                **{f"value_w25_{s}_ratio": fr.ratio_to_own_mean(F.col(f"value_w25_{s}"), w) for s in stats},
            }
        ).drop("_mean10")

    return over_series(_rename_value(df, spec), spec, fn, before=max(fr.WINDOWS) + fr.RATIO_WINDOW, **kw)


def full_frame(column: str, w: WindowSpec, n: int) -> Column:
    """The trailing ``n`` values as an array; NULL until the frame is full."""
    c = F.col(column)
    f = fr.trailing(w, n)
    return F.when(F.count(c).over(f) == n, F.collect_list(c).over(f))


def rolling_apply(df: DataFrame, spec: SeriesSpec, n: int, fn, out: str, **kw) -> DataFrame:
    """Window callback: ``fn`` maps the column of full trailing windows (arrays) to the output column."""

    def run(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = rows.withColumn("_frame", full_frame(spec.value, w, n))
        return rows.withColumn(out, fn(F.col("_frame"))).drop("_frame")

    return over_series(df, spec, run, before=n, **kw)


def smooth(df: DataFrame, spec: SeriesSpec, sigma: float = 3.0, out: str | None = None, **kw) -> DataFrame:
    """Gaussian smoothing, radius int(4 sigma + .5), edges mirrored (d c b a | a b c d | d c b a)."""
    import math

    r = int(4.0 * sigma + 0.5)
    weights = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    total = sum(weights)
    weights = [x / total for x in weights]
    out = out or spec.value

    def run(near: pd.Series, pos: pd.Series, total: pd.Series) -> pd.Series:
        x = np.zeros((len(near), 2 * r + 1))
        for i, values in enumerate(near):
            x[i, : len(values)] = values
        place, n = pos.to_numpy()[:, None], total.to_numpy()[:, None]
        # reflect repeatedly: period 2n, second half reversed
        at = np.mod(place + np.arange(-r, r + 1), 2 * n)
        x = np.take_along_axis(x, np.where(at >= n, 2 * n - 1 - at, at) - np.maximum(place - r, 0), axis=1)
        smoothed = np.zeros(len(near))
        for j, weight in enumerate(weights):  # in this order, so that equal surroundings give equal values
            smoothed += weight * x[:, j]
        return pd.Series(smoothed)

    run.__annotations__ = {"near": pd.Series, "pos": pd.Series, "total": pd.Series, "return": pd.Series}
    weighted = F.pandas_udf(run, "double")

    def fn(rows: DataFrame, w: WindowSpec) -> DataFrame:
        near = F.collect_list(F.coalesce(F.col(spec.value), F.lit(0.0))).over(w.rowsBetween(-r, r))
        return rows.withColumn("_near", near).withColumn(out, weighted("_near", POS, TOTAL)).drop("_near")

    return over_series(df, spec, fn, before=r, after=r, totals=True, **kw)


def with_peak_distance(df: DataFrame, spec: SeriesSpec, out: str = "rows_since_peak", **kw) -> DataFrame:
    """Rows since the last local maximum of ``spec.value``; -1 before the first.

    A flat top counts once, at its middle row (lower middle for an even length), when both
    neighbouring levels are lower.  Runs of equal values are found by grouping, so a flat top may
    have any length.
    """
    v = F.col(spec.value)
    kw.setdefault("stats", series_stats(df, spec.series))

    def marks(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns(
            {
                "_prev": F.lag(v).over(w),
                "_next": F.lead(v).over(w),
            }
        )

    rows = over_series(df, spec, marks, before=1, after=1, keep_pos=True, **kw)
    # a rise opens a candidate top, a fall closes it; between them the level is flat
    rises = F.col("_prev") < v
    falls = F.col("_next") < v
    rows = rows.withColumn("_open", F.when(rises, F.col(POS)).when(F.col("_prev") != v, F.lit(-1)))
    rows = fill_forward(rows, spec, {"_top_start": F.col("_open")}, **kw)
    rows = rows.withColumn(
        "_mid",
        F.when(falls & (F.col("_top_start") >= 0), F.floor((F.col("_top_start") + F.col(POS)) / 2)),
    )
    # a top's middle row lies at or before its closing row: look ahead for the next closing row
    rows = fill_forward(rows, spec, {"_close_mid": F.col("_mid")}, backward=True, **kw)
    rows = rows.withColumn("_peak", F.when(F.col("_close_mid") == F.col(POS), F.col(POS)))
    rows = fill_forward(rows, spec, {"_last_peak": F.col("_peak")}, **kw)
    since = F.coalesce(F.col(POS) - F.col("_last_peak"), F.lit(-1)).cast("long")
    return rows.withColumn(out, since).drop(
        POS, "_prev", "_next", "_open", "_top_start", "_mid", "_close_mid", "_peak", "_last_peak"
    )
