"""Labels and predictions in a row neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewatch.series import POS, SeriesSpec, over_series


def _near(c: Column, w: WindowSpec, slack: int) -> Column:
    """Largest value in rows [i - slack, i + slack - 1]; NULL for the first ``slack`` rows."""
    return F.when(F.col(POS) >= slack, F.max(c).over(w.rowsBetween(-slack, slack - 1)))


def adjust_predictions(
    df: DataFrame, spec: SeriesSpec, actual: str, predicted: str, slack: int = 5, out: str = "adjusted", **kw
) -> DataFrame:
    """Forgive errors close to an anomaly.

    A false positive near a true label becomes 0; a false negative near an original prediction
    becomes 1.  The first ``slack`` rows of a series are never changed.  An empty series key runs
    over the concatenation of all series.
    """

    def fn(rows: DataFrame, w: WindowSpec) -> DataFrame:
        y, p = F.col(actual), F.col(predicted)
        return rows.withColumn(
            out,
            F.when((p == 1) & (y == 0) & (_near(y, w, slack) > 0), 0)
            .when((p == 0) & (y == 1) & (_near(p, w, slack) > 0), 1)
            .otherwise(p),
        )

    return over_series(df, spec, fn, before=slack, after=slack, **kw)


def batch_labels(df: DataFrame, spec: SeriesSpec, label: str, history: int = 20, out: str = "batch_label", **kw) -> DataFrame:
    """1 if any of the previous ``history`` rows is labelled; the first ``history`` rows are 0."""

    def fn(rows: DataFrame, w: WindowSpec) -> DataFrame:
        any_before = F.max(label).over(w.rowsBetween(-history, -1))
        return rows.withColumn(out, F.when((F.col(POS) >= history) & (any_before > 0), 1).otherwise(0))

    return over_series(df, spec, fn, before=history, **kw)


def threshold_sweep(
    df: DataFrame, spec: SeriesSpec, actual: str, score: str, slack: int = 20, low: int = 50, high: int = 99, **kw
) -> DataFrame:
    """Adjusted precision, recall and F1 for every cut low%..high% (score >= cut is positive).

    Whether a row counts at a cut depends on one number only: the row's score, or for missed
    anomalies the best score nearby.  So each row adds to one bucket and the buckets are summed,
    instead of repeating the rows per threshold.
    """

    def fn(rows: DataFrame, w: WindowSpec) -> DataFrame:
        y, s = F.col(actual), F.col(score)
        forgiven = (y == 0) & (F.coalesce(_near(y, w, slack), F.lit(0)) > 0)
        best = F.greatest(s, F.coalesce(_near(s, w, slack), s))
        return rows.select(
            y.alias("y"), F.when(y == 1, best).when(forgiven, F.lit(None).cast("double")).otherwise(s).alias("reach")
        )

    rows = over_series(df, spec, fn, before=slack, after=slack, **kw)
    cuts = F.sequence(F.lit(low), F.lit(high))
    passed = F.size(F.filter(cuts, lambda i: F.col("reach") >= i / F.lit(100)))
    counts = rows.groupBy("y", passed.alias("passed")).agg(F.count(F.lit(1)).alias("n"))
    # at most 2 x (high - low + 2) rows from here on
    by_cut = counts.withColumn("threshold", F.explode(cuts)).groupBy("threshold").agg(
        F.sum(F.when((F.col("y") == 1) & (F.col("passed") > F.col("threshold") - low), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("y") == 0) & (F.col("passed") > F.col("threshold") - low), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when((F.col("y") == 1) & (F.col("passed") <= F.col("threshold") - low), F.col("n")).otherwise(0)).alias("fn"),
    )
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero)
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), zero)
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), zero)
    return by_cut.select("threshold", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def best_threshold(sweep: DataFrame, min_precision: float = 0.75) -> DataFrame:
    """First cut whose adjusted precision reaches the minimum."""
    return sweep.where(F.col("precision") >= min_precision).orderBy("threshold").limit(1)
