"""Scaling of series and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.quantiles import quantiles
from tidewatch.series import SeriesSpec, SeriesStats, join_keys, series_stats, small


def by_percentile(
    df: DataFrame, spec: SeriesSpec, percentile: float = 90.0, scale: float | None = None,
    stats: SeriesStats | None = None, **kw,
) -> DataFrame:
    """Divide the value by its series percentile (or by ``scale``); a zero divisor gives NULL."""
    if scale is not None:
        return df.withColumn(spec.value, F.try_divide(F.col(spec.value), F.lit(float(scale))))
    stats = stats or series_stats(df, spec.series)
    scales = quantiles(df, spec.series, spec.value, {"_scale": percentile / 100.0}, stats=stats, **kw)
    rows = join_keys(df, small(scales, stats.n_series), spec.series, "left")
    return rows.withColumn(spec.value, F.try_divide(F.col(spec.value), F.col("_scale"))).drop("_scale")


def _moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    ).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def standardise(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """(x - mean) / std with the statistics of ``train`` for every table."""
    m = _moments(train, columns)
    return [
        d.withColumns({c: F.try_divide(F.col(c) - F.lit(m[c][0]), F.lit(m[c][1])) for c in columns})
        for d in (train, *others)
    ]


def min_max(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """(x - min) / (max - min) fitted on ``train``; a constant column becomes 0."""
    row = train.agg(*[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"b_{c}") for c in columns]).first()

    def scaled(c: str):
        lo, hi = row[f"a_{c}"], row[f"b_{c}"]
        span = None if lo is None else float(hi) - float(lo)
        return F.lit(0.0) if not span else (F.col(c) - F.lit(float(lo))) / F.lit(span)

    return [d.withColumns({c: scaled(c) for c in columns}) for d in (train, *others)]


def zscore_per_group(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sample std per key group (machine); std 0 or NULL gives 0.

    Aggregate first and join the one row per group back, so a large group is never in one task.
    """
    stats = series_stats(df, keys)
    moments = df.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns]
    )
    rows = join_keys(df, small(moments, stats.n_series), keys, "left")
    rows = rows.withColumns(
        {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0)) for c in columns}
    )
    return rows.drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def replace_inf_with_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """+inf becomes the largest other value of its column."""
    inf = float("inf")
    row = df.agg(*[F.max(F.when(F.col(c) != inf, F.col(c))).alias(c) for c in columns]).first()
    return df.withColumns({c: F.when(F.col(c) == inf, F.lit(row[c])).otherwise(F.col(c)) for c in columns})
