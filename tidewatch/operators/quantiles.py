"""Exact quantiles per group (linear interpolation, or the nearest rank) that survive a huge group.

``F.percentile`` keeps the distinct values of a group in one buffer.  That is the plan while every
group is short.  For longer groups a mergeable sketch brackets every wanted rank, the rows below and
inside the bracket are counted, and only the distinct values inside (a few per hundred thousand
rows) are ranked.  Where the counts say that the rank lies outside, the bracket moves there; where it holds
more than ``group_rows`` distinct values, it is halved at their median until it does not.  Each such
step is one more aggregation, so any sketch leads to the exact value, a poor one later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.series import BLOCK_ROWS, SeriesStats, durable, join_keys, series_stats, small

SKETCH_ACCURACY = 100_000
GROUP = "_one"


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    probs: dict[str, float],
    nearest: bool = False,
    group_rows: int | None = None,
    accuracy: int = SKETCH_ACCURACY,
    stats: SeriesStats | None = None,
) -> DataFrame:
    """One row per group with a column per name in ``probs`` (NULL values are ignored).

    ``nearest`` picks the value at rank round-half-even((n - 1) * p) instead of interpolating.
    """
    group_rows = group_rows or BLOCK_ROWS
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull())
    stats = stats or series_stats(rows, keys)
    if stats.max_rows <= group_rows and not nearest:
        return rows.groupBy(*keys).agg(*[F.percentile("_v", p).alias(n) for n, p in probs.items()])
    return _ranked(rows, list(keys), probs, nearest, group_rows, accuracy, stats)


def _ranked(rows, keys, probs, nearest, group_rows, accuracy, stats) -> DataFrame:
    by = keys or [GROUP]
    if not keys:
        rows = rows.withColumn(GROUP, F.lit(0))
    margin = 3.0 / accuracy + 2.0 / group_rows  # sketch error, and two ranks for rounding
    edges = [x for p in probs.values() for x in (max(0.0, p - margin), min(1.0, p + margin))]
    sketch = F.percentile_approx("_v", edges, accuracy)
    brackets = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch.alias("_e")
    )
    if stats.max_rows > group_rows:
        brackets = durable(brackets)  # sketches are merged in any order: fix the brackets once
    names = list(probs)
    whole = F.col("_n") <= group_rows  # short groups are ranked as a whole
    ends, items = [], []
    for i, n in enumerate(names):
        p = probs[n]
        at = (F.col("_n") - 1) * F.lit(p)
        low = F.bround(at, 0) if nearest else F.floor(at)
        lo = F.when(whole | F.lit(p <= margin), F.col("_min")).otherwise(F.get("_e", F.lit(2 * i)))
        hi = F.when(whole | F.lit(p >= 1 - margin), F.col("_max")).otherwise(F.get("_e", F.lit(2 * i + 1)))
        for rank in [low] if nearest else [low, F.least(low + 1, F.col("_n") - 1)]:
            items.append(F.struct(rank.cast("long").alias("r"), lo.alias("lo"), hi.alias("hi"), F.lit(None).cast("double").alias("mid"), "_min", "_max"))
        ends.append(F.lit(0.0) if nearest else at - F.floor(at))
    wanted = brackets.select(*by, F.posexplode(F.array(*items)).alias("q", "_b")).select(*by, "q", "_b.*")
    weights = brackets.select(*by, F.array(*ends).alias("_w"))
    # distinct values first: one row per (group, value), counted map-side
    counted = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    if stats.max_rows > group_rows:
        wanted = _settled(counted, wanted, by, group_rows, stats.n_series * len(items))
    else:
        wanted = wanted.withColumn("_below", F.lit(0).cast("long"))
    side = small(wanted.select(*by, "q", "r", "lo", "hi", "_below"), stats.n_series * len(items))
    inside = join_keys(counted, side, by, "inner").where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
    w = Window.partitionBy(*by, "q").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.col("_below") + F.sum("_c").over(w)  # ranks [last - c, last) hold this value
    found = inside.withColumn("_last", last).where((F.col("r") < F.col("_last")) & (F.col("r") >= F.col("_last") - F.col("_c")))
    step = 1 if nearest else 2
    values = found.groupBy(*by).agg(*[F.max(F.when(F.col("q") == i, F.col("_v"))).alias(f"_q{i}") for i in range(len(items))])
    a = [F.col(f"_q{step * i}") for i in range(len(names))]
    b = [F.col(f"_q{step * i + step - 1}") for i in range(len(names))]
    wide = join_keys(values, small(weights, stats.n_series), by, "inner").select(
        *by, *[(a[i] + (b[i] - a[i]) * F.get("_w", F.lit(i))).alias(n) for i, n in enumerate(names)]
    )
    return wide if keys else wide.drop(GROUP)


def _settled(counted: DataFrame, wanted: DataFrame, by: list[str], most: int, n_wanted: int) -> DataFrame:
    """``wanted`` with brackets that hold their rank and at most ``most`` distinct values, and ``_below``,
    the rows of the group below the bracket."""
    counted, wanted = durable(counted), durable(wanted)
    inner = (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi"))
    rows_where = lambda c: F.coalesce(F.sum(F.when(c, F.col("_c"))), F.lit(0))
    while True:
        seen = join_keys(counted, small(wanted, n_wanted), by, "inner").groupBy(*by, "q", "r", "lo", "hi", "mid", "_min", "_max").agg(
            rows_where(F.col("_v") < F.col("lo")).alias("_below"), rows_where(F.col("_v") <= F.col("hi")).alias("_upto"),
            rows_where(F.col("_v") <= F.col("mid")).alias("_half"), F.count(F.when(inner, 1)).alias("_inside"),
            F.percentile_approx(F.when(inner, F.col("_v")), 0.5, 10_000).alias("_next"),
        )
        seen = durable(seen)
        under, over = F.col("r") < F.col("_below"), F.col("r") >= F.col("_upto")
        many = (F.col("_inside") > most) & (F.col("lo") < F.col("hi"))
        if seen.where(under | over | many).isEmpty():
            return seen
        left = F.col("r") < F.col("_half")
        halve = many & F.col("mid").isNotNull()
        lo = F.when(under, F.col("_min")).when(over, F.col("hi")).when(halve & ~left, F.col("mid")).otherwise(F.col("lo"))
        hi = F.when(under, F.col("lo")).when(over, F.col("_max")).when(halve & left, F.col("mid")).otherwise(F.col("hi"))
        # the median of the distinct values inside, for the next count; none in a bracket that has just moved
        moved = seen.select(*by, "q", "r", lo.alias("lo"), hi.alias("hi"), F.when(many & ~under & ~over & ~halve, F.col("_next")).alias("mid"), "_min", "_max")
        wanted = durable(moved)


def group_boundaries(df: DataFrame, keys: Sequence[str], distance: str, percentile: float = 99.0, **kw) -> DataFrame:
    """Upper boundary of ``distance`` per group (clusters): one percentile, as ``boundary``."""
    return quantiles(df, keys, distance, {"boundary": percentile / 100.0}, **kw)


def flag_above(df: DataFrame, score: str, percentile: float, out: str = "predicted", strict: bool = True,
               nearest: bool = False, magnitude: bool = False, **kw) -> DataFrame:
    """0/1 flag against a percentile of the score.

    ``strict``: score > cut.  Otherwise |score| >= cut.  ``magnitude`` takes the cut of |score|.
    """
    s = F.abs(score) if magnitude else F.col(score)
    cut = quantiles(df, [], s, {"_cut": percentile / 100.0}, nearest=nearest, **kw).first()
    limit = None if cut is None else cut["_cut"]
    hit = (s > F.lit(limit)) if strict else (F.abs(score) >= F.lit(limit))
    return df.withColumn(out, F.when(hit, 1).otherwise(0))
