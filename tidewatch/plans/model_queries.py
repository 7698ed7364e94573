"""Queries that fit or apply detectors."""

from __future__ import annotations

from dataclasses import replace
from itertools import product

from pyspark.sql import functions as F

from tidewatch.operators import balance, boosting, dense, detect, features, models, normalize, split, tolerance
from tidewatch.operators import evaluate as ev
from tidewatch.operators.embedding import flat, history_windows, matrix_windows
from tidewatch.operators.metrics_query import drop_quiet_series
from tidewatch.operators.ordered import prefix_counts
from tidewatch.plans.roles import LABELLED_SQL, TYPE, USER, Query, labelled, rounded, stats_sql
from tidewatch.plans.series_queries import _with_stats
from tidewatch.plans.io_queries import new_folder
from tidewatch.series import POS, join_keys, over_series, series_stats, with_positions, written
from tidewatch.sources import sinks

COLUMNS = ["value", "value_w5_mean", "value_w5_std", "value_w25_mean", "value_w25_std", "value_w25_zscore"]
SCORE_COLUMNS = ["event_id", "is_anomaly"]
CENTRE_COLUMNS = ["value", "value_w25_mean", "value_w25_std"]
DEALT = ("split", "fold", "in_test", "shown")
#: Rows of a series that a task computes rolling statistics of.
FEATURE_BLOCK = 100_000


def feature_rows(spark, sf, dealt=split.ordered_split, columns=COLUMNS):
    """Labelled events with the rolling statistics ``columns`` and the ordered split (or folds), written once: every fit
    and every later scan reads the table instead of repeating the windows.  Rows are dealt while they are narrow."""
    rows = labelled(spark, sf).select("event_id", "event_type", "ts", "value", "k", "is_anomaly")
    stats = series_stats(rows, TYPE.series)
    dealt_rows = dealt(rows, TYPE, stats=stats)
    out = over_series(dealt_rows, TYPE, lambda r, w: _with_stats(r, w), before=50, stats=stats, block_rows=FEATURE_BLOCK)
    return written(out.select(*rows.columns, *[c for c in columns if c not in rows.columns], *[c for c in DEALT if c in dealt_rows.columns]))


def profile_rows(spark, sf, profiles=tuple(detect.PROFILES)):
    """The table the profiles look at: every series divided by its 90th percentile, smoothed,
    with the cluster features and the ordered split, written once."""
    rows = labelled(spark, sf).select("event_id", "event_type", "ts", "value", "is_anomaly")
    stats = series_stats(rows, TYPE.series)
    rows = normalize.by_percentile(split.ordered_split(rows, TYPE, stats=stats), TYPE, 90.0, stats=stats)  # dealt while narrow
    rows = features.smooth(rows, TYPE, 3.0, stats=stats, block_rows=FEATURE_BLOCK)
    rows = features.cluster_features(rows, TYPE, stats=stats, block_rows=FEATURE_BLOCK)
    used = dict.fromkeys(c for p in profiles for c in ("value", *detect.Profile.named(p).features))
    return written(rows.select("event_id", "event_type", "ts", "is_anomaly", *used, "split"))


STATS_ROWS = stats_sql(f"SELECT event_id, event_type, ts, value, k, is_anomaly FROM ({LABELLED_SQL})")


def fixed_centres(spark, sf):
    """Distance to the nearest of the group means, and the flag beyond the 99th percentile."""
    rows = feature_rows(spark, sf, columns=CENTRE_COLUMNS)
    means = rows.groupBy("event_type").agg(*[F.avg(c).alias(c) for c in CENTRE_COLUMNS]).orderBy("event_type").collect()
    detector = detect.ClusterDetector(CENTRE_COLUMNS, [[r[c] for c in CENTRE_COLUMNS] for r in means])
    detector = detector.with_boundaries(rows.where("is_anomaly = 0"), 99.0)
    return rounded(detector.transform(rows).select("event_id", "cluster", "distance", "predicted"))


_DIST = "sqrt((r.value - c.a) ** 2 + (r.value_w25_mean - c.b) ** 2 + (r.value_w25_std - c.d) ** 2)"
CENTRES_SQL = f"""
WITH r AS MATERIALIZED ({STATS_ROWS}),
c AS (SELECT CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS cluster, avg(value) AS a, avg(value_w25_mean) AS b, avg(value_w25_std) AS d FROM r GROUP BY event_type),
n AS (SELECT event_id, any_value(is_anomaly) AS is_anomaly, arg_min(cluster, {_DIST}) AS cluster, min({_DIST}) AS distance FROM r, c GROUP BY event_id),
b AS (SELECT cluster, quantile_cont(distance, 0.99::DOUBLE) AS boundary FROM n WHERE is_anomaly = 0 GROUP BY cluster)
SELECT event_id, cluster, round(distance, 6) AS distance, CASE WHEN distance > boundary THEN 1 ELSE 0 END AS predicted FROM n LEFT JOIN b USING (cluster)"""


def cluster_detection(spark, sf):
    rows = profile_rows(spark, sf)
    return detect.detect_profiles(rows, [detect.Profile.named(p) for p in detect.PROFILES]).select(
        "event_id", "is_anomaly", "flag_spike", "flag_level_shift", "flag_dip", "predicted"
    )


def cluster_evaluation(spark, sf):
    rows = profile_rows(spark, sf)
    rows = detect.detect_profiles(rows, [detect.Profile.named(p) for p in detect.PROFILES])
    rows = tolerance.adjust_predictions(rows, TYPE, "is_anomaly", "predicted")
    return rounded(ev.evaluate_types(rows, "is_anomaly", {"original": "predicted", "adjusted": "adjusted"}))


def cross_dataset(spark, sf):
    """Fit on labelled series, flag the series of another table: its measure is renamed, quiet series are
    dropped before normalisation, then both are normalised and smoothed alike."""
    train = profile_rows(spark, sf, ["spike"]).where(F.col("event_type") != "view")
    other = labelled(spark, sf).where(F.col("event_type") == "view")
    other = other.select("event_id", F.concat_ws("|", "event_type", F.col("user_id") % 20).alias("event_type"), "ts", F.col("value").alias("throughput"), "is_anomaly")
    other = drop_quiet_series(other.withColumnRenamed("throughput", "value"), ["event_type"], "value", 100.0)
    stats = series_stats(other, TYPE.series)
    other = features.smooth(normalize.by_percentile(other, TYPE, 90.0, stats=stats), TYPE, 3.0, stats=stats)
    profile = detect.Profile.named("spike")
    other = written(features.cluster_features(other, TYPE, stats=stats).select("event_id", "event_type", "ts", "is_anomaly", *dict.fromkeys(("value", *profile.features))))
    out = detect.detect_profiles(other, [profile], train=train, percentile=detect.CROSS_DATASET_PERCENTILE)
    return out.select("event_id", "is_anomaly", "predicted")


def _model(name, cut=0.5, **kw):
    def build(spark, sf):
        rows = feature_rows(spark, sf)
        model = models.fit(name, rows.where("split = 'train'"), COLUMNS, **kw)
        return rounded(models.predict(model, rows.where("split = 'test'"), COLUMNS, cut).select(*SCORE_COLUMNS, "score", "predicted"), 4)

    return build


#: Depth-limited boosting with a penalty, rounds by folds with a short patience.
DEEP = boosting.Settings(step=0.1, leaves=32, depth=5, min_rows=1, fraction=1.0, penalty=1.0, min_curvature=1.0)


def folded(rows):
    return split.contiguous_folds(rows.drop("split"), TYPE, 5)


def boosting_rounds(spark, sf):
    """Loss of every fold after every number of rounds, at the detector's step; five contiguous folds."""
    train = feature_rows(spark, sf).where("split = 'train'")
    return rounded(boosting.choose_rounds(folded(train), COLUMNS, "fold").table(spark), 6)


def boosted_scores(spark, sf):
    """Rounds chosen by folds, refit with the small positive weight, cut at the detector's score."""
    rows = feature_rows(spark, sf)
    train = rows.where("split = 'train'")
    weighted = boosting.with_settings(positive_weight=models.POSITIVE_WEIGHT)
    model, _ = boosting.fit_by_folds(folded(train), COLUMNS, "fold", final=weighted)
    out = boosting.score(model, rows.where("split = 'test'").select(*SCORE_COLUMNS, *COLUMNS))
    return rounded(out.select(*SCORE_COLUMNS, "score", F.when(F.col("score") > models.SCORE_CUT, 1).otherwise(0).alias("predicted")), 4)


def early_boosting(spark, sf):
    """The early form: 100 rounds, raw probabilities."""
    rows = feature_rows(spark, sf)
    model = boosting.fit(rows.where("split = 'train'"), COLUMNS, rounds=100)
    return rounded(boosting.score(model, rows.where("split = 'test'")).select(*SCORE_COLUMNS, "score"), 4)


def deep_boosting(spark, sf):
    """Depth-5 trees, rounds chosen by folds (500 at most, patience 10), rounded probabilities."""
    rows = feature_rows(spark, sf)
    model, rounds = boosting.fit_by_folds(folded(rows.where("split = 'train'")), COLUMNS, "fold", settings=DEEP, most=500, patience=10)
    out = boosting.score(model, rows.where("split = 'test'").select(*SCORE_COLUMNS, *COLUMNS))
    return rounded(out.select(*SCORE_COLUMNS, "score", F.round("score").cast("int").alias("predicted"), F.lit(rounds.chosen).alias("rounds")), 4)


def gain_importances(spark, sf):
    """Share of the total gain by feature, largest first."""
    train = feature_rows(spark, sf).where("split = 'train'")
    model = boosting.fit(train, COLUMNS, settings=DEEP, rounds=5)
    return rounded(spark.createDataFrame(model.importances(), "feature string, importance double").orderBy(F.desc("importance"), "feature"), 4)


def _network(settings):
    """Five layers of 256 units, trained until ten epochs have not lowered the loss over the last 30 % of
    the training rows."""

    def build(spark, sf):
        rows = feature_rows(spark, sf)
        train = split.ordered_split(rows.where("split = 'train'").drop("split"), TYPE)
        model = dense.fit(train.where("split = 'train'"), COLUMNS, train.where("split = 'test'"), settings=settings)
        out = dense.score(model, rows.where("split = 'test'").select(*SCORE_COLUMNS, *COLUMNS))
        return rounded(out.select(*SCORE_COLUMNS, "score", F.when(F.col("score") > 0.5, 1).otherwise(0).alias("predicted")), 4)

    return build


def single_feature(spark, sf):
    """Training on the value alone: all other columns are left out."""
    rows = split.ordered_split(labelled(spark, sf).select("event_id", "event_type", "ts", "value", "is_anomaly"), TYPE)
    train, test = rows.where("split = 'train'").select("value", "is_anomaly"), rows.where("split = 'test'").select("event_id", "value", "is_anomaly")
    model = models.fit("ridge", train, ["value"])
    return rounded(models.score(model, test, ["value"]).select(*SCORE_COLUMNS, "score"), 4)


#: The normal equations of sum (y - a - b x)^2 + b^2.
SINGLE_SQL = f"""
WITH r AS MATERIALIZED (
  SELECT event_id, value, is_anomaly, 2 * is_anomaly - 1 AS y,
         row_number() OVER (ORDER BY event_type, ts, event_id) - 1 < count(*) OVER () - CAST(ceil(0.3::DOUBLE * count(*) OVER ()) AS BIGINT) AS train
  FROM ({LABELLED_SQL})),
m AS (SELECT avg(value) AS mx, avg(y) AS my, (count(*) * covar_pop(value, y)) / (count(*) * var_pop(value) + 1) AS b FROM r WHERE train)
SELECT event_id, is_anomaly, round(my + b * (value - mx), 4) AS score FROM r, m WHERE NOT train"""


def importances(spark, sf):
    rows = feature_rows(spark, sf)
    model = models.fit("deep_boosted_trees", rows.where("split = 'train'"), COLUMNS)
    return rounded(models.importance_rows(spark, model, COLUMNS), 4)


def model_evaluation(spark, sf):
    _, result = models.run_model("deep_boosted_trees", feature_rows(spark, sf), COLUMNS, TYPE)
    return rounded(result)


def fold_evaluation(spark, sf):
    rows = feature_rows(spark, sf, lambda r, spec, **kw: split.contiguous_folds(r, spec, 5, **kw), CENTRE_COLUMNS)

    def one(train, test):
        detector = detect.ClusterDetector.fit(train.where("is_anomaly = 0"), CENTRE_COLUMNS, 4)
        return detector.transform(test)

    result = models.run_folds(rows, "fold", 5, one, TYPE)
    return rounded(ev.fold_summary(result, ["accuracy", "precision", "recall", "auc", "f1"], keys=["type"]))


#: The listed settings of the parameter search.
SEARCH = {"step": [0.01, 0.05, 0.001, 0.0001], "depth": [2, 3, 5, 7], "positive_weight": [1.0, 4.0, 8.0, 0.25, 0.1, 0.03]}


def tuned(spark, sf):
    """All points of the grid on five contiguous folds, by successive halving."""
    train = feature_rows(spark, sf).where("split = 'train'")
    points = [replace(DEEP, step=e, depth=d, leaves=2**d, positive_weight=w) for e, d, w in product(*SEARCH.values())]
    return rounded(boosting.leaderboard(spark, boosting.search(folded(train), COLUMNS, "fold", points), list(SEARCH)), 6)


def saved_run(spark, sf):
    """A detector fitted, saved and loaded again; its scored test rows written and read back."""
    rows = feature_rows(spark, sf)
    folder = new_folder(spark)
    boosting.fit(rows.where("split = 'train'"), COLUMNS, settings=DEEP, rounds=5).save(spark, f"{folder}/model")
    model = boosting.Boosted.load(spark, f"{folder}/model")
    scored = boosting.score(model, rows.select("event_id", "event_type", "split", "is_anomaly", *COLUMNS)).withColumn("predicted", F.round("score").cast("int"))
    sinks.write_split(scored, f"{folder}/rows", "is_anomaly", "predicted")
    back = spark.read.parquet(f"{folder}/rows")
    return rounded(back.select("event_id", "split", "target", "predict", "score"), 6)


def saved_detector(spark, sf):
    """Centres and boundaries written and read back, applied to all rows."""
    rows = feature_rows(spark, sf, columns=CENTRE_COLUMNS)
    means = rows.groupBy("event_type").agg(*[F.avg(c).alias(c) for c in CENTRE_COLUMNS]).orderBy("event_type").collect()
    detector = detect.ClusterDetector(CENTRE_COLUMNS, [[r[c] for c in CENTRE_COLUMNS] for r in means]).with_boundaries(rows.where("is_anomaly = 0"), 99.0)
    path = f"{new_folder(spark)}/detector"
    detector.save(spark, path)
    return rounded(detect.ClusterDetector.load(spark, path).transform(rows).select("event_id", "cluster", "distance", "predicted"))


def isolation(spark, sf):
    rows = feature_rows(spark, sf)
    forest = detect.isolation_forest(rows, ["event_id"], COLUMNS)
    return rounded(forest.predict(rows).select(*SCORE_COLUMNS, "score", "predicted"), 6)


def isolation_share(spark, sf):
    return isolation(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("score") > 0) & (F.col("score") < 1)).alias("inside"))


def window_reconstruction(spark, sf):
    rows = labelled(spark, sf).select("event_id", "event_type", "ts", "value", "k", "is_anomaly")
    rows = normalize.zscore_per_group(rows, ["event_type"], ["value", "k"])
    windows = written(flat(matrix_windows(rows, TYPE, ["value", "k"], 5, "is_anomaly")).drop("window"))
    scored = detect.reconstruction_scores(windows.where("window_label = 0").select("vector"), windows, "vector", 4)
    return rounded(detect.flag_top_scores(scored).select("event_id", "window_label", "score", "predicted"), 4)


def projected(spark, sf):
    return rounded(detect.project_2d(feature_rows(spark, sf), COLUMNS).select(*SCORE_COLUMNS, "x", "y"), 4)


def score_quality(spark, sf):
    """Score curves of a fitted model on held-out rows: the measures of a semi-supervised run.  Labels are
    hidden while rows are narrow, scores written once for the four measures."""

    def hidden(rows, spec, **kw):
        return split.hide_labels(split.ordered_split(rows, spec, **kw), "is_anomaly", ["event_id"], 0.75, seed=1, out="shown")

    rows = feature_rows(spark, sf, hidden)
    train = rows.where("split = 'train'").drop("is_anomaly").withColumnRenamed("shown", "is_anomaly")
    model = models.fit("deep_boosted_trees", train, COLUMNS)
    scored = written(models.score(model, rows.where("split = 'test'"), COLUMNS).select("is_anomaly", "score"))
    flagged = detect.flag_score_magnitude(scored)
    parts = [
        ev.roc_auc(scored, "is_anomaly", "score").select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("v")),
        ev.precision_recall_areas(scored, "is_anomaly", "score").select(F.lit("pr_auc").alias("metric"), F.col("pr_auc").alias("v")),
        ev.recall_at_top(scored, "is_anomaly", "score", 99.0).select(F.lit("recall_1").alias("metric"), F.col("recall").alias("v")),
        ev.evaluate(flagged, "is_anomaly", "predicted").select(F.lit("f1").alias("metric"), F.col("f1").alias("v")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out, 4)


HISTORY = 150
#: Rows of a series that a task gives windows to.
HISTORY_BLOCK = 100_000

PLACE = "place"
PLACED = replace(TYPE, order=(PLACE,))


def history_places(spark, sf):
    """Narrow rows, written once: each with its place in its series and the fold its window falls to, of
    five contiguous ones over the rows that have a whole history (none for the others)."""
    rows = labelled(spark, sf).select("event_id", "event_type", "ts", "value", "is_anomaly")
    stats = series_stats(rows, TYPE.series)
    sizes = rows.groupBy(*TYPE.series).agg(F.greatest(F.count(F.lit(1)) - HISTORY, F.lit(0)).alias("_n"))
    n = F.lit(int(sizes.agg(F.sum("_n")).first()[0] or 0))
    rows = with_positions(rows, TYPE, stats=stats).withColumnRenamed(POS, PLACE)
    rows = join_keys(rows, prefix_counts(sizes, TYPE.series, TYPE.series), TYPE.series, "left")
    fold = F.when(F.col(PLACE) >= HISTORY, split.fold_of(F.col("_before") + F.col(PLACE) - HISTORY, n, 5))
    return written(rows.withColumn("fold", fold).drop("_before"))


def with_history(places):
    """The rows of a whole history with the 150 values before them."""
    windows = history_windows(places, PLACED, HISTORY, target="is_anomaly", block_rows=HISTORY_BLOCK)
    return windows.drop("value", "is_anomaly").withColumnRenamed("label", "is_anomaly")


def semi_windows(spark, sf):
    total = F.aggregate("window", F.lit(0.0), lambda a, x: a + x)
    return with_history(history_places(spark, sf)).select("event_id", "is_anomaly", "fold", F.size("window").alias("size"), F.round(total, 4).alias("window_sum"))


SEMI_SQL = f"""
WITH w AS (
  SELECT event_id, event_type, ts, is_anomaly, row_number() OVER o - 1 AS pos, count(*) OVER h AS size, sum(value) OVER h AS s FROM ({LABELLED_SQL})
  WINDOW o AS (PARTITION BY event_type ORDER BY ts, event_id), h AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN {HISTORY} PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, row_number() OVER (ORDER BY event_type, ts, event_id) - 1 AS g, count(*) OVER () AS n FROM w WHERE pos >= {HISTORY})
SELECT event_id, is_anomaly, (CASE WHEN g < (n % 5) * (n // 5 + 1) THEN g // (n // 5 + 1) ELSE n % 5 + (g - (n % 5) * (n // 5 + 1)) // (n // 5) END)::INTEGER AS fold,
  size::INTEGER AS size, round(s, 4) AS window_sum
FROM i"""


def semi_batches(spark, sf):
    """Window pairs for training: normal and anomalous windows in turn, drawn from the training folds.
    Drawn by their places; only the histories of the drawn rows are made into windows."""
    places = history_places(spark, sf)
    train = split.hide_labels(places.where("fold > 0"), "is_anomaly", ["event_id"], 0.75, seed=1)
    drawn = balance.alternating_batch(train.select("event_id", "event_type", PLACE, "is_anomaly"), "is_anomaly", ["event_id"], 512)
    drawn = written(drawn.select("slot", "is_anomaly", F.col("event_type").alias("_type"), F.col(PLACE).alias("_place")))  # 512 rows
    seen = drawn.select("_type", F.explode(F.sequence(F.col("_place") - HISTORY, "_place")).alias("_place")).distinct()
    # whole histories: the 150 rows before a drawn one are the same among these rows as among all
    near = places.join(F.broadcast(seen), F.col("event_type").eqNullSafe(F.col("_type")) & (F.col(PLACE) == F.col("_place")), "left_semi")
    windows = with_history(near).select("event_type", PLACE, "window")
    batch = windows.join(F.broadcast(drawn), F.col("event_type").eqNullSafe(F.col("_type")) & (F.col(PLACE) == F.col("_place")))
    return batch.groupBy((F.col("slot") % 2).alias("turn"), "is_anomaly", F.size("window").alias("size")).agg(F.count(F.lit(1)).alias("n"))


def semi_folds(spark, sf):
    """Each fold scored by what the others show: a quarter of their labels, windows rebuilt from normal
    ones, the top percent of the magnitudes flagged; originally and with neighbours, over the folds.
    What each fold may see is marked on narrow rows; the windows are written once and not moved."""
    places = history_places(spark, sf)
    for f in range(5):
        seen = split.hide_labels(places.where(F.col("fold") != f), "is_anomaly", ["event_id"], 0.75, seed=1, out=f"shown_{f}")
        rest = places.where((F.col("fold") == f) | F.col("fold").isNull()).withColumn(f"shown_{f}", F.lit(None).cast("int"))
        places = written(seen.unionByName(rest))
    rows = written(with_history(places).drop(PLACE))
    turn = iter(range(5))  # folds come in this order

    def one(train, test):
        normal = train.where(F.col(f"shown_{next(turn)}") == 0).select("window")
        scored = detect.reconstruction_scores(normal, test, "window", 4)
        return detect.flag_score_magnitude(scored.drop("window"))

    result = models.run_folds(rows, "fold", 5, one, TYPE)
    return rounded(ev.fold_summary(result, ["accuracy", "precision", "recall", "auc", "f1"], keys=["type"]))


def experiments(spark, sf):
    """Two rule detectors over all series at once, evaluated per series."""
    rows = feature_rows(spark, sf, columns=["value", "value_w25_zscore", "value_w50_mean"])
    detectors = {
        "zscore": lambda d: d.withColumn("predicted", F.when(F.col("value_w25_zscore") > 2, 1).otherwise(0)),
        "level": lambda d: d.withColumn("predicted", F.when(F.col("value") > 2 * F.col("value_w50_mean"), 1).otherwise(0)),
    }
    return rounded(models.apply_experiments(rows, "event_type", detectors))


def top_group_detection(spark, sf):
    """A fitted detector over the ten busiest users only, all groups in one transform."""
    from tidewatch.operators.profile import rows_of_top_keys

    rows = feature_rows(spark, sf)
    model = models.fit("deep_boosted_trees", rows, COLUMNS)
    groups = rows_of_top_keys(labelled(spark, sf), "user_id", "event_id").select("event_id", "user_id", "event_type", "ts", "value", "is_anomaly")
    groups = over_series(groups, USER, lambda r, w: _with_stats(r, w), before=50)
    return models.predict(model, groups, COLUMNS, models.GROUP_SCORE_CUT).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("predicted").alias("flags")
    )


def _rule_sql(name: str, rule: str) -> str:
    from tidewatch.plans.evaluation_queries import scores_sql

    source = f"SELECT event_type, is_anomaly, CASE WHEN {rule} THEN 1 ELSE 0 END AS p FROM ({STATS_ROWS})"
    return f"SELECT *, '{name}' AS detector FROM ({scores_sql(source, 'is_anomaly', 'p', 'event_type')})"


EXPERIMENTS_SQL = _rule_sql("zscore", "value_w25_zscore > 2") + " UNION ALL " + _rule_sql("level", "value > 2 * value_w50_mean")

QUERIES = [
    Query("nearest_centre_boundary", fixed_centres, CENTRES_SQL),
    Query("cluster_detection", cluster_detection),
    Query("cluster_detection_evaluation", cluster_evaluation),
    Query("cross_dataset_detection", cross_dataset),
    Query("boosting_rounds", boosting_rounds),
    Query("boosted_trees_scores", boosted_scores),
    Query("early_boosting_scores", early_boosting),
    Query("deep_boosting_scores", deep_boosting),
    Query("gain_importances", gain_importances),
    Query("random_forest_scores", _model("random_forest", balance="weight", trees=1000)),
    Query("single_feature_ridge", single_feature, SINGLE_SQL),
    Query("ridge_scores", _model("ridge", 0.0)),
    Query("ridge_weighted_scores", _model("ridge", 0.0, balance="weight")),
    Query("dense_network_scores", _network(dense.PLAIN)),
    Query("dense_network_weighted_scores", _network(dense.WEIGHTED)),
    Query("top_group_detection", top_group_detection),
    Query("feature_importances", importances),
    Query("model_evaluation", model_evaluation),
    Query("fold_evaluation", fold_evaluation),
    Query("model_search_leaderboard", tuned),
    Query("saved_run", saved_run),
    Query("saved_detector", saved_detector, CENTRES_SQL),
    Query("isolation_scores", isolation),
    Query("isolation_score_range", isolation_share, "SELECT count(*) AS n, count(*) AS inside FROM events"),
    Query("window_reconstruction", window_reconstruction),
    Query("two_component_projection", projected),
    Query("score_quality", score_quality),
    Query("semi_supervised_windows", semi_windows, SEMI_SQL),
    Query("semi_supervised_batches", semi_batches, f"SELECT turn, turn AS is_anomaly, {HISTORY}::INTEGER AS size, 256::BIGINT AS n FROM (SELECT DISTINCT (event_id % 2)::BIGINT AS turn FROM events)"),
    Query("semi_supervised_folds", semi_folds),
    Query("rule_experiments", experiments, EXPERIMENTS_SQL),
]
