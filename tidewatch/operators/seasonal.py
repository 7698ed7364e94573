"""Periods, seasonal decomposition and spectra of whole series as transforms, aggregates and row frames."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.operators import fourier
from tidewatch.operators.ordered import running_sums
from tidewatch.series import POS, TOTAL, SeriesSpec, durable, join_keys, over_series, series_stats, small


def autocorrelation(df: DataFrame, spec: SeriesSpec, **kw) -> DataFrame:
    """One row per series and lag 1 .. ceil(n / 2) - 1: the normalised autocorrelation
    sum((x_t - m)(x_{t+l} - m)) / (var * (n - l)).  All lags come from one padded transform."""
    v = F.col(spec.value)
    stats = series_stats(df, spec.series)
    moments = df.groupBy(*spec.series).agg(F.avg(v).alias("_mean"), F.var_samp(v).alias("_var"))
    rows = join_keys(_indexed(df, spec, **kw), small(moments, stats.n_series), spec.series, "left")
    products = fourier.lagged_products(rows, spec.series, POS, TOTAL, v - F.col("_mean"))
    near = products.where((F.col("lag") > 0) & (F.col("lag") <= F.ceil(F.col("n") / 2) - 1))
    long = join_keys(near, small(moments, stats.n_series), spec.series, "left")
    r = F.try_divide(F.col("_sum"), F.col("_var") * (F.col("n") - F.col("lag")))
    return long.select(*spec.series, F.col("lag").cast("int").alias("lag"), r.alias("r"))


def period(df: DataFrame, spec: SeriesSpec, min_lag: int = 1, strength: float = 0.5, **kw) -> DataFrame:
    """Strongest |r| per series with its lag; ``period`` only if |r| > strength and lag > min_lag."""
    acf = autocorrelation(df, spec, **kw)
    best = acf.groupBy(*spec.series).agg(
        F.max_by(F.struct("lag", "r"), F.struct(F.abs("r"), -F.col("lag"))).alias("b")
    )
    ok = (F.abs(F.col("b.r")) > strength) & (F.col("b.lag") > min_lag)
    return best.select(*spec.series, F.col("b.lag").alias("lag"), F.col("b.r").alias("r"), F.when(ok, F.col("b.lag")).alias("period"))


def decompose(df: DataFrame, spec: SeriesSpec, p: int, **kw) -> DataFrame:
    """Additive decomposition with period ``p``: columns trend, seasonal, residual (edges NULL)."""
    half = p // 2
    v = F.col(spec.value)

    def fn(rows: DataFrame, w: WindowSpec) -> DataFrame:
        if p % 2:
            f = w.rowsBetween(-half, half)
            trend = F.when(F.count(v).over(f) == p, F.sum(v).over(f) / p)
        else:
            inner = w.rowsBetween(-(half - 1), half - 1)
            ends = (F.lag(v, half).over(w) + F.lead(v, half).over(w)) / 2
            trend = F.when(F.count(v).over(inner) == p - 1, (F.sum(v).over(inner) + ends) / p)
        return rows.withColumns({"trend": trend, "_phase": F.col(POS) % p})

    stats = series_stats(df, spec.series)
    rows = over_series(df, spec, fn, before=half, after=half, stats=stats, **kw)
    detrended = v - F.col("trend")
    phases = rows.groupBy(*spec.series, "_phase").agg(F.avg(detrended).alias("_a"))
    centre = phases.groupBy(*spec.series).agg(F.avg("_a").alias("_c"))
    phases = join_keys(phases, small(centre, stats.n_series), spec.series, "inner")
    phases = phases.withColumn("seasonal", F.col("_a") - F.col("_c")).drop("_a", "_c")
    rows = join_keys(rows, small(phases, stats.n_series * p), [*spec.series, "_phase"], "left")
    return rows.withColumn("residual", v - F.col("trend") - F.col("seasonal")).drop("_phase")


def remove_seasonality(df: DataFrame, spec: SeriesSpec, min_lag: int = 1, **kw) -> DataFrame:
    """Value becomes the residual of its decomposition where the series has a period, else it stays.

    One pass for all periods: the trend is a difference of running sums, met by position."""
    stats = series_stats(df, spec.series)
    periods = period(df, spec, min_lag, **kw).where("period IS NOT NULL").select(*spec.series, F.col("period").cast("long").alias("_p"))
    rows = join_keys(_indexed(df, spec, **kw), small(periods, stats.n_series), spec.series, "left")
    still = rows.where(F.col("_p").isNull())
    rows = durable(rows.where(F.col("_p").isNotNull()))
    v, half = F.col(spec.value), F.floor(F.col("_p") / 2)
    sums = running_sums(rows.select(*spec.series, POS, v.alias("_v")), POS, ["_v"], spec.series, **kw).select(*spec.series, POS, F.col("cum__v").alias("_s"))

    def at(frame: DataFrame, offset: Column, name: str) -> DataFrame:
        """The running sum ``offset`` rows on (0 before the first row, missing behind the last)."""
        frame = frame.withColumn("_at", F.col(POS) + offset)
        right = sums.select(*spec.series, F.col(POS).alias("_at"), F.col("_s").alias(name))
        frame = join_keys(frame, right, [*spec.series, "_at"], "left")
        return frame.withColumn(name, F.when(F.col("_at") == -1, 0.0).otherwise(F.col(name))).drop("_at")

    # odd: the p values around the row; even: half of each end, which is the mean of two shifted sums
    even = F.col("_p") % 2 == 0
    rows = at(at(rows, half, "_a"), -half - 1, "_b")
    rows = at(at(rows, half - 1, "_c"), -half, "_d")
    wide, narrow = F.col("_a") - F.col("_b"), F.col("_c") - F.col("_d")
    trend = F.when(even, (wide + narrow) / (2 * F.col("_p"))).otherwise(wide / F.col("_p"))
    rows = rows.withColumn("_x", v - trend).withColumn("_phase", F.col(POS) % F.col("_p"))
    phases = rows.groupBy(*spec.series, "_phase").agg(F.avg("_x").alias("_ph"))
    centre = phases.groupBy(*spec.series).agg(F.avg("_ph").alias("_ce"))
    phases = join_keys(phases, small(centre, stats.n_series), spec.series, "inner").select(*spec.series, "_phase", (F.col("_ph") - F.col("_ce")).alias("_season"))
    rows = join_keys(rows, phases, [*spec.series, "_phase"], "left")
    return still.select(*df.columns).unionByName(rows.withColumn(spec.value, F.col("_x") - F.col("_season")).select(*df.columns))


def _angle(k: Column | int) -> Column:
    """2 pi k t / n with the product reduced modulo n first, so that the angle stays small."""
    bin_number = F.lit(k) if isinstance(k, int) else k
    turns = F.pmod(bin_number.cast("long") * F.col(POS).cast("long"), F.col(TOTAL))
    return turns / F.col(TOTAL) * (2 * math.pi)


def spectrum(df: DataFrame, spec: SeriesSpec, **kw) -> DataFrame:
    """Power of all positive frequency bins 1 .. n / 2 of each series, any series length.

    re and im are sum(v cos) and sum(v sin); period = int(1 / frequency) with frequency = bin / n.
    """
    rows = _indexed(df, spec, **kw)
    bins = fourier.any_length(rows, spec.series, POS, TOTAL, F.col(spec.value)).where((F.col("bin") > 0) & (2 * F.col("bin") <= F.col("n")))
    return bins.select(
        *spec.series, "n", F.col("bin").cast("int").alias("bin"), "re", (-F.col("im")).alias("im"),
        (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"), F.floor(F.col("n") / F.col("bin")).alias("period"),
    )


def _indexed(df: DataFrame, spec: SeriesSpec, **kw) -> DataFrame:
    from tidewatch.series import with_positions, with_totals

    stats = series_stats(df, spec.series)
    return with_totals(with_positions(df, spec, stats=stats, **kw), spec.series, stats)


def strongest_bins(spectra: DataFrame, spec: SeriesSpec, top_k: int) -> DataFrame:
    """The ``top_k`` bins by power per series (one row per series and rank).

    Bins are ranked in sections of the spectrum first, so that no task sorts a whole one."""
    section = F.floor(F.col("bin") / 65_536)
    by = [F.desc("power"), F.asc("bin")]
    local = spectra.withColumn("_sec", section).withColumn("_r", F.row_number().over(Window.partitionBy(*spec.series, "_sec").orderBy(*by))).where(F.col("_r") <= top_k)
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy(*(list(spec.series) or [F.lit(0)])).orderBy(*by)))
    return ranked.where(F.col("rank") <= top_k).select(*spec.series, "rank", "bin", "period", "power", "re", "im", "n")


def remove_bins(df: DataFrame, spec: SeriesSpec, bins: DataFrame, out: str = "filtered", **kw) -> DataFrame:
    """Subtract the given bins (and their mirrors) from the series."""
    packed = bins.groupBy(*spec.series).agg(F.collect_list(F.struct("bin", "re", "im")).alias("_b"))
    rows = join_keys(_indexed(df, spec, **kw), small(packed, series_stats(df, spec.series).n_series), spec.series, "left")
    n = F.col(TOTAL)

    def wave(b: Column) -> Column:
        a = _angle(b["bin"])
        half = F.when(b["bin"] * 2 == n, 1.0).otherwise(2.0)
        return half / n * (b["re"] * F.cos(a) + b["im"] * F.sin(a))

    total = F.aggregate(F.transform(F.col("_b"), wave), F.lit(0.0), lambda acc, x: acc + x)
    return rows.withColumn(out, F.col(spec.value) - F.coalesce(total, F.lit(0.0))).drop("_b", POS, TOTAL)


def sine(spark: SparkSession, samples: int, periods: Sequence[float], amplitude: float = 1.0) -> DataFrame:
    """Test signal: sum of sines with the given periods, one row per sample."""
    t = F.col("id")
    value = reduce(lambda a, b: a + b, [F.sin(t * (2 * math.pi / p)) * amplitude for p in periods])
    return spark.range(samples).select(t.alias("ts"), value.alias("value"))
