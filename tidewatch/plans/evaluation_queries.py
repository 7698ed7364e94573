"""Queries that evaluate predictions and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import evaluate as ev
from tidewatch.operators import quantiles as qt
from tidewatch.operators import tolerance
from tidewatch.operators.detect import flag_score_magnitude
from tidewatch.plans.roles import LABELLED_SQL, TYPE, Query, labelled, rounded, table, tagged_events
from tidewatch.plans.series_queries import adjust_sql

PERCENTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p97": 0.97, "p99": 0.99, "p999": 0.999}
METRICS = ["accuracy", "precision", "recall", "auc", "f1"]


def scores_sql(source: str, y: str, p: str, keys: str = "", digits: int = 6) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""
SELECT *, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), {digits}) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), {digits}) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), {digits}) AS recall, round(coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 0), {digits}) AS auc,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), {digits}) AS f1
FROM (SELECT {head}count(*) FILTER (WHERE {y} = 0 AND {p} = 0) AS tn, count(*) FILTER (WHERE {y} = 0 AND {p} = 1) AS fp,
        count(*) FILTER (WHERE {y} = 1 AND {p} = 0) AS fn, count(*) FILTER (WHERE {y} = 1 AND {p} = 1) AS tp FROM ({source}) {group})"""


BY_SCORE = f"SELECT score, count(*) FILTER (WHERE is_anomaly = 1) AS pos, count(*) FILTER (WHERE is_anomaly = 0) AS neg FROM ({LABELLED_SQL}) GROUP BY score"
DOWN = f"SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM ({BY_SCORE})"
CURVE = f"SELECT score AS threshold, tp / (tp + fp) AS precision, tp / p AS recall FROM ({DOWN})"


def crosstab(spark, sf):
    return rounded(ev.confusion_rows(labelled(spark, sf), "is_anomaly", "predicted"))


CROSSTAB_SQL = f"""
SELECT predicted, actual_0, actual_1, round(actual_0 / sum(actual_0) OVER (), 6) AS actual_0_share, round(actual_1 / sum(actual_1) OVER (), 6) AS actual_1_share
FROM (SELECT predicted, count(*) FILTER (WHERE is_anomaly = 0) AS actual_0, count(*) FILTER (WHERE is_anomaly = 1) AS actual_1 FROM ({LABELLED_SQL}) GROUP BY predicted)"""


def original_and_adjusted(spark, sf):
    rows = tolerance.adjust_predictions(labelled(spark, sf), TYPE, "is_anomaly", "predicted")
    return rounded(ev.evaluate_types(rows, "is_anomaly", {"original": "predicted", "adjusted": "adjusted"}))


TYPES_SQL = f"""
SELECT *, 'original' AS type FROM ({scores_sql(LABELLED_SQL, 'is_anomaly', 'predicted')}) UNION ALL
SELECT *, 'adjusted' AS type FROM ({scores_sql(adjust_sql(), 'is_anomaly', 'adjusted')})"""


def sweep(spark, sf):
    return rounded(tolerance.threshold_sweep(labelled(spark, sf), TYPE, "is_anomaly", "score"))


SWEEP = f"""
SELECT threshold, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
       coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (
  SELECT CAST(threshold AS INTEGER) AS threshold, count(*) FILTER (WHERE y = 1 AND a = 1) AS tp, count(*) FILTER (WHERE y = 0 AND a = 1) AS fp, count(*) FILTER (WHERE y = 1 AND a = 0) AS fn FROM (
    SELECT threshold, y, CASE WHEN pos >= 20 AND p = 1 AND y = 0 AND max(y) OVER f > 0 THEN 0 WHEN pos >= 20 AND p = 0 AND y = 1 AND max(p) OVER f > 0 THEN 1 ELSE p END AS a FROM (
      SELECT t.threshold, event_type, ts, event_id, is_anomaly AS y, CASE WHEN score >= t.threshold / 100.0::DOUBLE THEN 1 ELSE 0 END AS p,
             row_number() OVER (PARTITION BY t.threshold, event_type ORDER BY ts, event_id) - 1 AS pos FROM ({LABELLED_SQL}), range(50, 100) t(threshold))
    WINDOW f AS (PARTITION BY threshold, event_type ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING)) GROUP BY threshold)"""
SWEEP_SQL = f"SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM ({SWEEP})"


def best_threshold(spark, sf):
    return rounded(tolerance.best_threshold(tolerance.threshold_sweep(labelled(spark, sf), TYPE, "is_anomaly", "score"), 0.4))


def _quantile_sql(keys: str, value: str, source: str) -> str:
    return f"SELECT {keys}, " + ", ".join(f"round(quantile_cont({value}, {p}::DOUBLE), 6) AS {n}" for n, p in PERCENTILES.items()) + f" FROM {source} GROUP BY {keys}"


def boundaries(spark, sf):
    rows = tagged_events(spark, sf).withColumn("distance", F.abs(F.col("value") - 50))
    return rounded(qt.group_boundaries(rows, ["event_type"], "distance", 99.9))


def nearest_rank_flags(spark, sf):
    rows = qt.flag_above(labelled(spark, sf), "score", 97.0, nearest=True)
    return rows.select("event_id", "predicted")


def top_share_flags(spark, sf):
    return flag_score_magnitude(labelled(spark, sf), "score", 99.0).select("event_id", "predicted")


def auc(spark, sf):
    return rounded(ev.roc_auc(labelled(spark, sf), "is_anomaly", "score"))


AUC_SQL = f"""
SELECT round((sum(r) FILTER (WHERE is_anomaly = 1) - count(*) FILTER (WHERE is_anomaly = 1) * (count(*) FILTER (WHERE is_anomaly = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (WHERE is_anomaly = 1) * count(*) FILTER (WHERE is_anomaly = 0)), 6) AS roc_auc
FROM (SELECT is_anomaly, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM ({LABELLED_SQL}))"""


def curve(spark, sf):
    return rounded(ev.precision_recall_curve(labelled(spark, sf), "is_anomaly", "score"))


def lowest_precision(spark, sf):
    return rounded(ev.lowest_precision_above(ev.precision_recall_curve(labelled(spark, sf), "is_anomaly", "score"), 0.45))


def areas(spark, sf):
    return rounded(ev.precision_recall_areas(labelled(spark, sf), "is_anomaly", "score"))


AREAS_SQL = f"""
SELECT round(sum((recall - coalesce(r0, 0)) * (precision + coalesce(p0, 1)) / 2), 6) AS pr_auc, round(sum((recall - coalesce(r0, 0)) * precision), 6) AS average_precision
FROM (SELECT *, lag(recall) OVER (ORDER BY threshold DESC) AS r0, lag(precision) OVER (ORDER BY threshold DESC) AS p0 FROM ({CURVE}))"""


def roc(spark, sf):
    return rounded(ev.roc_curve(labelled(spark, sf), "is_anomaly", "score").select("threshold", "fpr", "tpr"))


def equal_error(spark, sf):
    return rounded(ev.equal_error_threshold(labelled(spark, sf), "is_anomaly", "score"))


EQUAL_SQL = f"""
SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM (
  SELECT *, sign(tpr - (1 - fpr)) AS s, lead(sign(tpr - (1 - fpr))) OVER (ORDER BY threshold DESC) AS s2
  FROM (SELECT score AS threshold, fp / n AS fpr, tp / p AS tpr FROM ({DOWN}))) WHERE s <> s2"""


def recall_top(spark, sf):
    one = rounded(ev.recall_at_top(labelled(spark, sf), "is_anomaly", "score", 99.0)).withColumn("top", F.lit(1))
    three = rounded(ev.recall_at_top(labelled(spark, sf), "is_anomaly", "score", 97.0)).withColumn("top", F.lit(3))
    return one.unionByName(three)


RECALL_TOP_SQL = " UNION ALL ".join(
    f"""SELECT round(count(*) FILTER (WHERE is_anomaly = 1 AND score > cut) / count(*) FILTER (WHERE is_anomaly = 1), 6) AS recall, {t} AS top FROM ({LABELLED_SQL}),
    (SELECT max(score) FILTER (WHERE r = round_even((n - 1) * {p}::DOUBLE, 0)) AS cut FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS r, count(*) OVER () AS n FROM ({LABELLED_SQL})))"""
    for t, p in ((1, 0.99), (3, 0.97))
)


def folds(spark, sf):
    return rounded(ev.fold_summary(ev.evaluate(labelled(spark, sf), "is_anomaly", "predicted", ["event_type"]).withColumn("run", F.lit("a")), METRICS, keys=["run"]))


def report(spark, sf):
    rows = ev.evaluate(labelled(spark, sf), "is_anomaly", "predicted", ["user_id"])
    rows = rows.withColumn("kind", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    summary = ev.fold_summary(rows, METRICS, population=True, keys=["kind"])
    nested = ev.metric_report(summary, "kind", "metric", "mean", "std")
    flat = nested.select(F.explode("report").alias("kind", "m")).select("kind", F.explode("m").alias("metric", "s"))
    return rounded(flat.select("kind", "metric", "s.avg", "s.std"))


_PER_USER = scores_sql(LABELLED_SQL, "is_anomaly", "predicted", "user_id", 15)
REPORT_SQL = " UNION ALL ".join(
    f"SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS kind, '{m}' AS metric, round(avg({m}), 6) AS avg, round(stddev_pop({m}), 6) AS std FROM ({_PER_USER}) GROUP BY 1"
    for m in METRICS
)
_PER_TYPE = scores_sql(LABELLED_SQL, "is_anomaly", "predicted", "event_type", 15)
FOLDS_SQL = " UNION ALL ".join(
    f"SELECT 'a' AS run, '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std, round(min({m}), 6) AS min, round(max({m}), 6) AS max FROM ({_PER_TYPE})"
    for m in METRICS
)


def majority(spark, sf):
    rows = labelled(spark, sf).withColumn("day", F.to_date("ts"))
    return ev.majority_label(rows, ["user_id", "day"], "is_anomaly", 2)


def median_vote(spark, sf):
    rows = labelled(spark, sf).withColumn("third", F.col("k") / 100)
    return ev.median_vote(rows, ["score", "predicted", "third", "is_anomaly"]).select("event_id", "ensemble")


def union_flags(spark, sf):
    rows = labelled(spark, sf).withColumns({"a": F.when(F.col("value") > 150, 1).otherwise(0), "b": F.when(F.col("k") > 95, 1).otherwise(0)})
    return ev.union_flags(rows, ["a", "b", "predicted"], "any_flag").select("event_id", "any_flag")


_DRAW = "(CAST('0x' || substr(md5('0|' || CAST(i AS VARCHAR) || '|{}'), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE"
DEVIATION_SQL = f"""
WITH z AS (SELECT sqrt(-2.0 * ln({_DRAW.format('a')})) * cos(2.0 * pi() * ({_DRAW.format('b')})) AS z FROM range(5000) t(i)),
r AS (SELECT avg(z) AS m, stddev_pop(z) AS s FROM z),
d AS (SELECT is_anomaly AS y, (score - m) / s AS dev FROM ({LABELLED_SQL}), r)
SELECT round_even(avg((1 - y) * abs(dev) + y * greatest(5.0 - dev, 0.0)), 6) AS loss FROM d"""

QUERIES = [
    Query("confusion_matrix", lambda s, d: ev.confusion(labelled(s, d), "is_anomaly", "predicted"), f"SELECT tn, fp, fn, tp FROM ({scores_sql(LABELLED_SQL, 'is_anomaly', 'predicted')})"),
    Query("confusion_crosstab", crosstab, CROSSTAB_SQL),
    Query("evaluation_scores", lambda s, d: rounded(ev.evaluate(table(s, d, "labels"), "quality", "toxic")), scores_sql("SELECT * FROM labels", "quality", "toxic")),
    Query("evaluation_per_series", lambda s, d: rounded(ev.evaluate(labelled(s, d), "is_anomaly", "predicted", ["user_id"])), scores_sql(LABELLED_SQL, "is_anomaly", "predicted", "user_id")),
    Query("evaluation_original_adjusted", original_and_adjusted, TYPES_SQL),
    Query("threshold_sweep", sweep, SWEEP_SQL),
    Query("first_good_threshold", best_threshold, f"SELECT * FROM ({SWEEP_SQL}) WHERE precision >= 0.4 ORDER BY threshold LIMIT 1"),
    Query("percentiles_per_series", lambda s, d: rounded(qt.quantiles(tagged_events(s, d), ["user_id"], "value", PERCENTILES)), _quantile_sql("user_id", "value", "events")),
    Query("percentiles_ranked", lambda s, d: rounded(qt.quantiles(table(s, d, "lineitem"), ["l_returnflag"], "l_extendedprice", PERCENTILES, group_rows=1000)), _quantile_sql("l_returnflag", "l_extendedprice", "lineitem")),
    Query("group_boundaries", boundaries, "SELECT event_type, round(quantile_cont(abs(value - 50), 0.999::DOUBLE), 6) AS boundary FROM events GROUP BY event_type"),
    Query("nearest_rank_flags", nearest_rank_flags, f"SELECT event_id, CASE WHEN score > cut THEN 1 ELSE 0 END AS predicted FROM ({LABELLED_SQL}), (SELECT max(score) FILTER (WHERE r = round_even((n - 1) * 0.97::DOUBLE, 0)) AS cut FROM (SELECT score, row_number() OVER (ORDER BY score) - 1 AS r, count(*) OVER () AS n FROM ({LABELLED_SQL})))"),
    Query("magnitude_percentile_flags", top_share_flags, f"SELECT event_id, CASE WHEN abs(score) >= (SELECT quantile_cont(score, 0.99::DOUBLE) FROM ({LABELLED_SQL})) THEN 1 ELSE 0 END AS predicted FROM ({LABELLED_SQL})"),
    Query("roc_auc", auc, AUC_SQL),
    Query("precision_recall_curve", curve, f"SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM ({CURVE})"),
    Query("lowest_precision_above", lowest_precision, f"SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM ({CURVE}) WHERE precision > 0.45 ORDER BY precision, recall DESC, threshold LIMIT 1"),
    Query("precision_recall_areas", areas, AREAS_SQL),
    Query("roc_curve", roc, f"SELECT round(score, 6) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM ({DOWN})"),
    Query("equal_error_threshold", equal_error, EQUAL_SQL),
    Query("recall_at_top", recall_top, RECALL_TOP_SQL),
    Query("fold_summary", folds, FOLDS_SQL),
    Query("metric_report", report, REPORT_SQL),
    Query("majority_label", majority, f"SELECT user_id, CAST(ts AS DATE) AS day, CASE WHEN sum(is_anomaly) >= 2 THEN 1 ELSE 0 END AS label FROM ({LABELLED_SQL}) GROUP BY ALL"),
    Query("median_vote", median_vote, f"SELECT event_id, round_even(list_median([score, predicted::DOUBLE, k / 100.0::DOUBLE, is_anomaly::DOUBLE]), 0) AS ensemble FROM ({LABELLED_SQL})"),
    Query("union_of_flags", union_flags, f"SELECT event_id, greatest(CASE WHEN value > 150 THEN 1 ELSE 0 END, CASE WHEN k > 95 THEN 1 ELSE 0 END, predicted) AS any_flag FROM ({LABELLED_SQL})"),
    Query("deviation_loss", lambda s, d: rounded(ev.deviation_loss(labelled(s, d), "is_anomaly", "score")), DEVIATION_SQL),
]
