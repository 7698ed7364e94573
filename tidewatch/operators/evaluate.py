"""Evaluation of 0/1 predictions and of scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordered import running_sums
from tidewatch.operators.quantiles import flag_above


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts ``tn fp fn tp`` (optionally per key), one row."""
    y, p = F.col(actual), F.col(predicted)
    return df.groupBy(*keys).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def confusion_rows(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Crosstab (predicted rows, actual columns) with counts and shares of the column total."""
    counts = (
        df.groupBy(F.col(predicted).alias("predicted"))
        .pivot(actual, [0, 1])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
        .withColumnsRenamed({"0": "actual_0", "1": "actual_1"})
    )
    w = Window.partitionBy(F.lit(0))  # two rows
    return counts.select(
        "*", *[_zero(F.try_divide(F.col(c), F.sum(c).over(w))).alias(f"{c}_share") for c in ("actual_0", "actual_1")]
    )


def scores(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, auc, f1 from confusion counts; undefined ratios are 0.

    The area under the curve of a 0/1 prediction is (recall + specificity) / 2, and 0 when only
    one class is present.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.withColumns(
        {
            "accuracy": _zero(F.try_divide(tp + tn, tp + tn + fp + fn)),
            "precision": _zero(F.try_divide(tp, tp + fp)),
            "recall": _zero(F.try_divide(tp, tp + fn)),
            "auc": _zero((F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2),
            "f1": _zero(F.try_divide(2 * tp, 2 * tp + fp + fn)),
        }
    )


def evaluate(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    return scores(confusion(df, actual, predicted, keys))


def evaluate_types(df: DataFrame, actual: str, columns: dict[str, str]) -> DataFrame:
    """Union of evaluations, one row per ``type`` (for example original and adjusted)."""
    out = None
    for kind, column in columns.items():
        row = evaluate(df, actual, column).withColumn("type", F.lit(kind))
        out = row if out is None else out.unionByName(row)
    return out


def by_score(df: DataFrame, actual: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: the pre-aggregate behind every curve."""
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(actual) == 1).alias("pos"), F.count_if(F.col(actual) == 0).alias("neg")
    )


def roc_auc(df: DataFrame, actual: str, score: str, **kw) -> DataFrame:
    """Rank statistic with ties counted half; 0 when only one class is present."""
    rows = running_sums(by_score(df, actual, score), "score", ["neg"], **kw)
    total = rows.agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
        F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2)).alias("u"),
    )
    return total.select(_zero(F.try_divide(F.col("u"), F.col("p").cast("double") * F.col("n"))).alias("roc_auc"))


def _descending(df: DataFrame, actual: str, score: str, **kw) -> DataFrame:
    """Per distinct score: true and false positives when everything >= score is positive."""
    counts = by_score(df, actual, score).withColumn("_down", -F.col("score"))
    rows = running_sums(counts, "_down", ["pos", "neg"], **kw)
    return rows.select("score", "_down", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))


def precision_recall_curve(df: DataFrame, actual: str, score: str, **kw) -> DataFrame:
    """threshold, precision, recall for every distinct score."""
    rows = _descending(df, actual, score, **kw)
    positives = df.agg(F.count_if(F.col(actual) == 1).alias("p")).first()["p"]
    return rows.select(
        F.col("score").alias("threshold"),
        _zero(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))).alias("precision"),
        _zero(F.try_divide(F.col("tp"), F.lit(positives))).alias("recall"),
    )


def lowest_precision_above(curve: DataFrame, cut: float = 0.75) -> DataFrame:
    """The curve row with the lowest precision above the cut (highest recall breaks ties)."""
    return curve.where(F.col("precision") > cut).orderBy("precision", F.desc("recall"), "threshold").limit(1)


def precision_recall_areas(df: DataFrame, actual: str, score: str, **kw) -> DataFrame:
    """``pr_auc`` (trapezoids, closed at recall 0 / precision 1) and ``average_precision`` (steps).

    Each curve row needs only its own counts: the previous point is (tp - pos, fp - neg).
    """
    rows = _descending(df, actual, score, **kw)
    p = rows.agg(F.sum("pos")).first()[0] or 0
    prev_tp, prev_fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    before = F.coalesce(F.try_divide(prev_tp, prev_tp + prev_fp), F.lit(1.0))
    step = F.try_divide(F.col("pos"), F.lit(p))
    return rows.agg(
        _zero(F.sum(step * (precision + before) / 2)).alias("pr_auc"),
        _zero(F.sum(step * precision)).alias("average_precision"),
    )


def roc_curve(df: DataFrame, actual: str, score: str, **kw) -> DataFrame:
    """threshold, fpr, tpr for every distinct score."""
    rows = _descending(df, actual, score, **kw)
    t = rows.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return rows.select(
        F.col("score").alias("threshold"),
        _zero(F.try_divide(F.col("fp"), F.lit(t["n"]))).alias("fpr"),
        _zero(F.try_divide(F.col("tp"), F.lit(t["p"]))).alias("tpr"),
        _zero(F.try_divide(F.col("fp") - F.col("neg"), F.lit(t["n"]))).alias("prev_fpr"),
        _zero(F.try_divide(F.col("tp") - F.col("pos"), F.lit(t["p"]))).alias("prev_tpr"),
    )


def equal_error_threshold(df: DataFrame, actual: str, score: str, **kw) -> DataFrame:
    """Curve points just before the sign of tpr - (1 - fpr) changes."""
    curve = roc_curve(df, actual, score, **kw)
    now = F.signum(F.col("tpr") - (1 - F.col("fpr")))
    prev = F.signum(F.col("prev_tpr") - (1 - F.col("prev_fpr")))
    crossing = curve.where(now != prev)
    # the point before the crossing is the next higher threshold: at most two crossings exist
    points = [r["threshold"] for r in crossing.select("threshold").collect()]
    out = None
    for t in points:
        above = curve.where(F.col("threshold") > t).orderBy("threshold").limit(1)
        out = above if out is None else out.unionByName(above)
    base = out if out is not None else curve.limit(0)
    return base.select("threshold", "fpr", "tpr")


def recall_at_top(df: DataFrame, actual: str, score: str, percentile: float, **kw) -> DataFrame:
    """Recall when only scores above the (nearest rank) percentile of |score| are positive."""
    flagged = flag_above(df, score, percentile, "_top", nearest=True, magnitude=True, **kw)
    return evaluate(flagged, actual, "_top").select("recall")


def fold_summary(df: DataFrame, metrics: Sequence[str], population: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """mean, std, min, max per metric; population std for run reports, sample std for folds."""
    std = F.stddev_pop if population else F.stddev_samp
    long = df.unpivot(list(keys) or [F.lit(0).alias("_k")], list(metrics), "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), std("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def metric_report(summary: DataFrame, group: str, metric: str, avg: str, std: str) -> DataFrame:
    """One JSON-ready row: {group: {metric: {avg, std}}}."""
    inner = summary.groupBy(group).agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct(F.col(metric), F.struct(F.col(avg).alias("avg"), F.col(std).alias("std")))))
        ).alias("m")
    )
    return inner.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(group), F.map_entries("m"))))).alias("e")).select(
        F.transform_values("e", lambda _, v: F.map_from_entries(v)).alias("report")
    )


def majority_label(df: DataFrame, keys: Sequence[str], vote: str, needed: int = 2, out: str = "label") -> DataFrame:
    """1 when at least ``needed`` annotators voted 1."""
    return df.groupBy(*keys).agg(F.when(F.sum(vote) >= needed, 1).otherwise(0).alias(out))


def median_vote(df: DataFrame, columns: Sequence[str], out: str = "ensemble") -> DataFrame:
    """Median of model outputs per row, rounded half to even."""
    n = len(columns)
    s = F.array_sort(F.array(*[F.col(c).cast("double") for c in columns]))
    mid = F.get(s, F.lit(n // 2)) if n % 2 else (F.get(s, F.lit(n // 2 - 1)) + F.get(s, F.lit(n // 2))) / 2
    return df.withColumn(out, F.bround(mid, 0))


def union_flags(df: DataFrame, columns: Sequence[str], out: str = "predicted") -> DataFrame:
    return df.withColumn(out, F.greatest(*columns) if len(columns) > 1 else F.col(columns[0]))


def deviation_loss(df: DataFrame, actual: str, score: str, margin: float = 5.0, reference: int = 5000, seed: int = 0) -> DataFrame:
    """Mean deviation loss against a standard normal reference sample of fixed size.

    The draws are a formula of (seed, number), so they do not depend on partitions: two uniform
    values from an md5, turned into a normal one.
    """

    def uniform(side: str) -> Column:
        digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"), F.lit(side)).cast("binary")), 1, 13)
        return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(2**52)

    z = F.sqrt(-2.0 * F.log(uniform("a"))) * F.cos(2.0 * math.pi * uniform("b"))
    ref = df.sparkSession.range(reference).select(z.alias("z")).agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).first()
    dev = (F.col(score) - F.lit(ref["m"])) / F.lit(ref["s"])
    y = F.col(actual)
    loss = (1 - y) * F.abs(dev) + y * F.greatest(F.lit(margin) - dev, F.lit(0.0))
    return df.agg(F.avg(loss).alias("loss"))
