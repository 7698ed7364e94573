"""Queries through files and streams: written to the shared folder, read back.

Every run takes a new folder; streams run until the given table is consumed and write files, so
nothing passes through the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import frames as fr
from tidewatch.operators import evaluate as ev
from tidewatch.operators import split
from tidewatch.operators.detect import ClusterDetector
from tidewatch.operators.ordered import with_global_index
from tidewatch.plans.evaluation_queries import CURVE, scores_sql
from tidewatch.plans.roles import LABELLED_SQL, TAGGED_SQL, TYPE, Query, events, labelled, rounded, rounded_sql, stat_names, stats_sql, tagged_events
from tidewatch.series import shared_folder
from tidewatch.sources import sinks, tables
from tidewatch.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tidewatch-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    rows = reader.option("maxFilesPerTrigger", 1000).parquet(sf)  # bounds a micro-batch
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame) -> DataFrame:
    """Run the stream over all available input into files; returns the files' rows."""
    spark = stream.sparkSession
    folder = new_folder(spark)
    jobs.append_to_files(stream, f"{folder}/out", f"{folder}/state", "parquet").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def csv_round_trip(spark, sf):
    rows = events(spark, sf).select("event_id", "event_type", "ts", "value")
    path = new_folder(spark)
    sinks.write_csv(rows, path, TYPE)
    return tables.read_csv(spark, path, "index BIGINT, event_id BIGINT, event_type STRING, ts TIMESTAMP, value DOUBLE")


def keyed_files(spark, sf):
    path = new_folder(spark)
    sinks.write_by_key(events(spark, sf).select("event_id", "event_type", "value"), path, ["event_type"])
    back = spark.read.schema("event_id BIGINT, value DOUBLE, event_type STRING").parquet(path)
    return back.where(F.col("event_type") == "view")  # reads one key's folder only


def series_files(spark, sf):
    path = new_folder(spark)
    rows = events(spark, sf).select("event_id", "user_id", "value")
    sinks.write_by_key(rows.withColumn("series", F.col("user_id")), path, ["series"], "csv", header=True)
    back = tables.read_series(spark, path, "event_id BIGINT, user_id BIGINT, value DOUBLE", by_folder=True, recursiveFileLookup=True)
    return back.select("series_id", "event_id", "user_id", "value")


def listed_series(spark, sf):
    """Two files of one folder as two series in a stated order; the id is the file's name."""
    schema = "c_custkey BIGINT, c_acctbal DOUBLE, s_suppkey BIGINT, s_acctbal DOUBLE"
    rows = tables.read_series(spark, sf, schema, "{customer,supplier,nation}.parquet", "parquet")
    rows = tables.select_series(rows, ["supplier", "customer"])
    value = F.coalesce("c_acctbal", "s_acctbal")
    return rows.select("series_id", "series_pos", F.coalesce("c_custkey", "s_suppkey").alias("id"), value.alias("value"))


LISTED_SQL = """
SELECT 'supplier' AS series_id, 0::INTEGER AS series_pos, s_suppkey AS id, s_acctbal AS value FROM supplier
UNION ALL SELECT 'customer', 1::INTEGER, c_custkey, c_acctbal FROM customer"""


def semicolon_scan(spark, sf):
    """Semicolons between the cells and commas in the numbers."""
    path = new_folder(spark)
    rows = events(spark, sf).select("event_id", "event_type", F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")).alias("value"))
    rows.write.csv(path, header=True, sep=";")
    back = tables.read_csv(spark, path, "event_id BIGINT, event_type STRING, value STRING", sep=";")
    return tables.decimal_columns(back, ["value"])


def machine_matrices(spark, sf):
    """A matrix without header and a label file per machine, numbered by their lines and put together."""
    path = new_folder(spark)
    rows = labelled(spark, sf).select("user_id", "ts", "event_id", "value", "k", "is_anomaly")
    sinks.write_matrices(rows, f"{path}/rows", "user_id", ["ts", "event_id"], ["event_id", "value", "k"])
    sinks.write_matrices(rows, f"{path}/labels", "user_id", ["ts", "event_id"], ["is_anomaly"])
    matrix = tables.read_matrix(spark, f"{path}/rows", ["event_id", "value", "k"]).drop("machine_id")
    labels = tables.read_labels(spark, f"{path}/labels").drop("machine_id")
    both = tables.attach_labels(matrix, labels, ["folder", "row_idx"])
    return both.select(F.substring_index("folder", "=", -1).alias("machine"), "row_idx", "event_id", "value", "k", "label")


MATRICES_SQL = f"""
SELECT user_id::VARCHAR AS machine, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_idx,
  event_id::DOUBLE AS event_id, value, k::DOUBLE AS k, is_anomaly AS label
FROM ({LABELLED_SQL})"""


def index_join(spark, sf):
    """Values and labels, each numbered on its own, joined by the number."""
    rows = labelled(spark, sf)
    values = with_global_index(rows.select("event_type", "ts", "event_id", "value"), TYPE, "idx")
    labels = with_global_index(rows.select("event_type", "ts", "event_id", "is_anomaly"), TYPE, "idx").select("idx", "is_anomaly")
    return values.join(labels, "idx").select("idx", "event_id", "value", "is_anomaly")


INDEX_SQL = f"SELECT row_number() OVER (ORDER BY event_type, ts, event_id) - 1 AS idx, event_id, value, is_anomaly FROM ({LABELLED_SQL})"


def split_dump(spark, sf):
    """Train and test rows with target and prediction, written by split and read back."""
    rows = labelled(spark, sf).select("event_id", "event_type", "ts", "value", "is_anomaly", "predicted")
    path = new_folder(spark)
    sinks.write_split(split.ordered_split(rows, TYPE), path, "is_anomaly", "predicted")
    return spark.read.parquet(path).select("event_id", "value", "target", "predict", "split")


SPLIT_SQL = f"""
SELECT event_id, value, is_anomaly AS target, predicted AS predict,
  CASE WHEN row_number() OVER (ORDER BY event_type, ts, event_id) - 1 < count(*) OVER () - CAST(ceil(0.3::DOUBLE * count(*) OVER ()) AS BIGINT) THEN 'train' ELSE 'test' END AS split
FROM ({LABELLED_SQL})"""


def written_curve(spark, sf):
    """Every point of the precision and recall curve as CSV, read back."""
    path = new_folder(spark)
    sinks.write_csv(ev.precision_recall_curve(labelled(spark, sf), "is_anomaly", "score"), path)
    return rounded(tables.read_csv(spark, path, "threshold DOUBLE, precision DOUBLE, recall DOUBLE"))


def written_experiments(spark, sf):
    """The scores of a rule on every series as CSV, read back."""
    path = new_folder(spark)
    result = ev.evaluate(labelled(spark, sf), "is_anomaly", "predicted", ["event_type"])
    sinks.write_csv(result, path)
    back = tables.read_csv(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in result.schema))
    return rounded(back)


def stats_lines(spark, sf):
    path = new_folder(spark)
    ev = tagged_events(spark, sf)
    raw = ev.select(
        F.col("event_id"), F.col("event_type").alias("container"), F.col("ts").alias("timestamp"),
        F.struct(F.struct(F.col("k").cast("long").alias("total")).alias("usage")).alias("cpu"),
        F.struct(F.col("user_id").alias("working_set")).alias("memory"),
    )
    sinks.write_json_lines(raw, path)
    back = spark.read.schema(f"event_id BIGINT, container STRING, {tables.STATS_SCHEMA}").json(path)
    return tables.stats_samples(back).select("event_id", "container", "cpu_usage", "memory_usage")


def stream_unique(spark, sf):
    rows = event_stream(spark, sf).select(F.col("event_type").alias("container"), F.date_trunc("hour", "ts").alias("timestamp"))
    return finished(jobs.unique_samples(rows))


def stream_means(spark, sf):
    rows = event_stream(spark, sf).select("event_type", F.col("ts").alias("timestamp"), "value")
    folder = new_folder(spark)
    jobs.append_tumbling_sums(rows, f"{folder}/out", f"{folder}/state", ["value"], ["event_type"], seconds=3600).awaitTermination()
    return rounded(jobs.means_so_far(spark.read.parquet(f"{folder}/out"), ["value"], ["event_type"]))


MEANS_SQL = """
SELECT event_type, make_timestamp(c) AS datetime, round_even(avg(value), 6) AS value_mean
FROM (SELECT *, (epoch_us(ts) + 1800000000) // 3600000000 * 3600000000 AS c FROM events)
GROUP BY event_type, c"""


def stream_scores(spark, sf):
    detector = ClusterDetector(["value"], [[10.0], [60.0], [150.0]], [9.0, 30.0, 80.0])
    rows = jobs.score_stream(event_stream(spark, sf).select("event_id", "value"), detector)
    return rounded(finished(rows))


SCORES_SQL = """
SELECT event_id, value, cluster, round_even(distance, 6) AS distance, CASE WHEN distance > [9, 30, 80][cluster + 1] THEN 1 ELSE 0 END AS predicted FROM (
  SELECT event_id, value, least(abs(value - 10), abs(value - 60), abs(value - 150)) AS distance,
    CASE WHEN abs(value - 10) <= abs(value - 60) AND abs(value - 10) <= abs(value - 150) THEN 0 WHEN abs(value - 60) <= abs(value - 150) THEN 1 ELSE 2 END AS cluster FROM events)"""


def stream_features(spark, sf):
    """The events dealt to five files without regard to time, one file per micro-batch."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKS)  # several state variables per key need it
    try:
        folder = new_folder(spark)
        dealt = events(spark, sf).select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
        dealt.repartition(5, F.xxhash64("event_id")).write.parquet(folder)
        rows = spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return rounded(jobs.latest_features(finished(jobs.rolling_features(rows, "event_type", fr.WINDOWS))).drop("ts", "series"))
    finally:
        spark.conf.set(provider, before)


FEATURES = stat_names()
WRITTEN_CURVE_SQL = f"SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM ({CURVE})"
EV = "SELECT event_id, event_type, ts, value FROM events"

QUERIES = [
    Query("csv_round_trip", csv_round_trip, "SELECT row_number() OVER (ORDER BY event_type, ts, event_id) - 1 AS index, event_id, event_type, ts, value FROM events"),
    Query("keyed_files_one_key", keyed_files, "SELECT event_id, event_type, value FROM events WHERE event_type = 'view'"),
    Query("series_files", series_files, "SELECT user_id::VARCHAR AS series_id, event_id, user_id, value FROM events"),
    Query("listed_series", listed_series, LISTED_SQL),
    Query("semicolon_scan", semicolon_scan, "SELECT event_id, event_type, value FROM events"),
    Query("machine_matrices", machine_matrices, MATRICES_SQL),
    Query("index_join", index_join, INDEX_SQL),
    Query("split_dump", split_dump, SPLIT_SQL),
    Query("written_curve", written_curve, WRITTEN_CURVE_SQL),
    Query("written_experiments", written_experiments, scores_sql(LABELLED_SQL, "is_anomaly", "predicted", "event_type")),
    Query("container_stats_lines", stats_lines, f"SELECT event_id, event_type AS container, k::BIGINT AS cpu_usage, user_id AS memory_usage FROM ({TAGGED_SQL})"),
    Query("stream_unique_samples", stream_unique, "SELECT DISTINCT event_type AS container, date_trunc('hour', ts) AS timestamp FROM events"),
    Query("stream_tumbling_means", stream_means, MEANS_SQL),
    Query("stream_scores", stream_scores, SCORES_SQL),
    Query("stream_rolling_features", stream_features, f"SELECT event_id, {rounded_sql(FEATURES)} FROM ({stats_sql(EV)})"),
]
