"""Rounding, resampling, merging and filling of metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.series import SeriesSpec, fill_forward, series_stats


def round_time(ts: Column, seconds: int = 10) -> Column:
    """Nearest multiple of ``seconds``; ties go to the even multiple."""
    unit = seconds * 1_000_000
    us = F.unix_micros(ts)
    rest = F.pmod(us, F.lit(unit))
    down = us - rest
    odd = F.pmod(F.floor(down / unit), F.lit(2)) == 1
    up = (rest * 2 > unit) | ((rest * 2 == unit) & odd)
    return F.timestamp_micros(F.when(up, down + unit).otherwise(down))


def mean_by_time(df: DataFrame, columns: Sequence[str], time: str = "datetime", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, time).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key, without a window over the key group: one mergeable minimum."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def interpolate_by_time(df: DataFrame, columns: Sequence[str], time: str = "datetime", keys: Sequence[str] = (), **kw) -> DataFrame:
    """Linear in time between neighbours; after the last value it stays; before the first stays NULL."""
    spec = SeriesSpec(tuple(keys), (time,), columns[0])
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.unix_micros(time).alias("t"), F.col(c).cast("double").alias("v"))) for c in columns}
    stats = series_stats(df, spec.series)
    rows = fill_forward(df, spec, {f"_b_{c}": s for c, s in known.items()}, stats=stats, **kw)
    rows = fill_forward(rows, spec, {f"_a_{c}": s for c, s in known.items()}, backward=True, stats=stats, **kw)
    t = F.unix_micros(time)

    def filled(c: str) -> Column:
        b, a = F.col(f"_b_{c}"), F.col(f"_a_{c}")
        share = F.try_divide(t - b["t"], a["t"] - b["t"])
        between = b["v"] + (a["v"] - b["v"]) * share
        return F.coalesce(F.col(c).cast("double"), F.when(b.isNotNull(), F.coalesce(between, b["v"])))

    rows = rows.withColumns({c: filled(c) for c in columns})
    return rows.drop(*[f"_{x}_{c}" for c in columns for x in "ab"])


def merge_metrics(
    app: DataFrame, system: DataFrame, app_columns: Sequence[str], system_columns: Sequence[str],
    app_order: Sequence[str], seconds: int = 10, keys: Sequence[str] = (),
) -> DataFrame:
    """Round both tables, average the system samples, keep the first app row per time, full outer
    join, interpolate, fill the rest with 0.  Input time column: ``datetime``."""
    a = app.withColumn("_t0", F.col("datetime")).withColumn("datetime", round_time(F.col("datetime"), seconds))
    a = first_per_key(a, [*keys, "datetime"], ["_t0", *app_order]).select(*keys, "datetime", *app_columns)
    s = system.withColumn("datetime", round_time(F.col("datetime"), seconds))
    s = mean_by_time(s, system_columns, keys=keys)
    merged = a.join(s, [*keys, "datetime"], "full")
    columns = [*app_columns, *[f"{c}_mean" for c in system_columns]]
    return interpolate_by_time(merged, columns, keys=keys).na.fill(0.0, columns)
