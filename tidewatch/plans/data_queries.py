"""Queries that split, balance and encode rows, and search neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import balance, encode, embedding, neighbors, normalize, split
from tidewatch.plans.roles import ALL, LABELLED_SQL, TAGGED_SQL, TYPE, USER, Query, events, labelled, order_sql, rounded, table, tagged_events
from tidewatch.series import durable

TRAIN, TEST = "o_orderdate < '1999-01-01'", "o_orderdate >= '1999-01-01'"
TRAIN_SQL, TEST_SQL = "o_orderdate < TIMESTAMP '1999-01-01'", "o_orderdate >= TIMESTAMP '1999-01-01'"


def orders(spark, sf):
    o = table(spark, sf, "orders").withColumn("target", F.when(F.col("o_totalprice") > 400000, 1).otherwise(0))
    return o.where(TRAIN), o.where(TEST), o


ORDERS = "(SELECT *, CASE WHEN o_totalprice > 400000 THEN 1 ELSE 0 END AS target FROM orders)"


def ordered_split(spark, sf):
    return split.ordered_split(events(spark, sf).select("event_id", "event_type", "ts"), TYPE).select("event_id", "split")


ORDERED_SQL = "SELECT event_id, CASE WHEN row_number() OVER (ORDER BY event_type, ts, event_id) - 1 < (SELECT count(*) - CAST(ceil(0.3::DOUBLE * count(*)) AS BIGINT) FROM events) THEN 'train' ELSE 'test' END AS split FROM events"


def stratified(spark, sf):
    rows = split.stratified_split(labelled(spark, sf), "is_anomaly", ["event_id"], 0.2, seed=7)
    return rows.groupBy("is_anomaly", "split").agg(F.count(F.lit(1)).alias("n"))


STRATIFIED_SQL = f"""
WITH c AS (SELECT is_anomaly, count(*) AS n, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT) AS t FROM ({LABELLED_SQL}) GROUP BY is_anomaly)
SELECT is_anomaly, 'test' AS split, t AS n FROM c UNION ALL SELECT is_anomaly, 'train' AS split, n - t AS n FROM c"""


def contiguous(spark, sf):
    rows = split.contiguous_folds(events(spark, sf).select("event_id", "event_type", "ts"), TYPE, 7, omit_last=True)
    return rows.select("event_id", "fold", "in_test")


CONTIGUOUS_SQL = """
SELECT event_id, CAST(b - 1 AS INTEGER) AS fold, coalesce(lead(b) OVER (ORDER BY event_type, ts, event_id) = b, FALSE) AS in_test
FROM (SELECT *, ntile(7) OVER (ORDER BY event_type, ts, event_id) AS b FROM events)"""


def series_folds(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return split.stratified_series_folds(c, "c_custkey", "c_mktsegment", "c_custkey", 5).select("c_custkey", "fold")


SERIES_FOLDS_SQL = """
WITH s AS (SELECT c_custkey, c_mktsegment, min(c_custkey) OVER (PARTITION BY c_mktsegment) AS f FROM customer),
g AS (SELECT *, (row_number() OVER (ORDER BY f, c_custkey) - 1) % 5 AS m, row_number() OVER (PARTITION BY f ORDER BY c_custkey) AS j FROM s)
SELECT a.c_custkey, CAST(b.m AS INTEGER) AS fold FROM g a JOIN (SELECT f, m, row_number() OVER (PARTITION BY f ORDER BY m) AS j FROM g) b USING (f, j)"""


def window_split(spark, sf):
    rows = tagged_events(spark, sf).withColumn("is_anomaly", F.when(F.col("value") > 120, 1).otherwise(0))
    spec = type(TYPE)((), ("ts", "event_id"))
    windows = embedding.matrix_windows(rows, spec, ["value", "k"], 5, "is_anomaly")
    total = windows.count()
    out = split.window_split(windows, "window_index", total)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


WINDOW_SPLIT_SQL = """
SELECT CASE WHEN i < floor(0.4::DOUBLE * n) THEN 'train' WHEN i < floor(0.5::DOUBLE * n) THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(event_id) AS first, max(event_id) AS last
FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () - 5 AS n FROM events) WHERE i < n GROUP BY 1"""


def normal_windows(spark, sf):
    rows = labelled(spark, sf).select("event_id", "ts", "value", "k", "is_anomaly")
    windows = embedding.matrix_windows(rows, ALL, ["value", "k"], 5, "is_anomaly").select("event_id", "ts", "window_label")
    return split.normal_window_split(durable(windows), ALL).select("event_id", "window_label", "split")


NORMAL_WINDOWS_SQL = f"""
WITH w AS (
  SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () - 5 AS n,
         max(is_anomaly) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS window_label FROM ({LABELLED_SQL})),
m AS (SELECT *, row_number() OVER (PARTITION BY window_label ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY window_label) AS m FROM w WHERE i < n)
SELECT event_id, window_label, CASE WHEN window_label = 1 THEN 'test' WHEN j < floor(0.4::DOUBLE * m) THEN 'train' WHEN j < floor(0.5::DOUBLE * m) THEN 'validation' ELSE 'test' END AS split FROM m"""


def hidden(spark, sf):
    rows = split.hide_labels(labelled(spark, sf), "is_anomaly", ["event_id"], 0.75, seed=3, out="shown")
    return rows.groupBy("is_anomaly", "shown").agg(F.count(F.lit(1)).alias("n"))


HIDDEN_SQL = f"""
WITH c AS (SELECT count(*) FILTER (WHERE is_anomaly = 0) AS neg, count(*) FILTER (WHERE is_anomaly = 1) AS pos, CAST(round_even(0.75::DOUBLE * count(*) FILTER (WHERE is_anomaly = 1), 0) AS BIGINT) AS h FROM ({LABELLED_SQL}))
SELECT 0 AS is_anomaly, 0 AS shown, neg AS n FROM c UNION ALL SELECT 1 AS is_anomaly, 0 AS shown, h AS n FROM c UNION ALL SELECT 1 AS is_anomaly, 1 AS shown, pos - h AS n FROM c"""


def replicated(spark, sf):
    rows = balance.replicate_positives(labelled(spark, sf).select("event_id", "is_anomaly"), "is_anomaly")
    return rows.groupBy("event_id", "is_anomaly").agg(F.count(F.lit(1)).alias("copies"))


REPLICATED_SQL = f"""
SELECT event_id, is_anomaly, CASE WHEN is_anomaly = 1 THEN r ELSE 1 END AS copies FROM ({LABELLED_SQL}),
  (SELECT CAST(round_even(count(*) FILTER (WHERE is_anomaly = 0) / count(*) FILTER (WHERE is_anomaly = 1) / 2, 0) AS BIGINT) AS r FROM ({LABELLED_SQL}))"""


def smote(spark, sf):
    rows = labelled(spark, sf).withColumn("is_anomaly", F.when(F.col("value") > 150, 1).otherwise(0))
    out = balance.smote_undersample(rows, "is_anomaly", "event_id", ["value", "k"], seed=11)
    return out.groupBy("is_anomaly", "synthetic").agg(F.count(F.lit(1)).alias("n"))


SMOTE_SQL = """
WITH c AS (SELECT count(*) FILTER (WHERE value <= 150) AS neg, count(*) FILTER (WHERE value > 150) AS pos FROM events),
t AS (SELECT *, greatest(pos, CAST(floor(0.1::DOUBLE * neg) AS BIGINT)) AS target FROM c)
SELECT 0 AS is_anomaly, 0 AS synthetic, least(neg, CAST(floor(target / 0.5::DOUBLE) AS BIGINT)) AS n FROM t
UNION ALL SELECT 1 AS is_anomaly, 0 AS synthetic, pos AS n FROM t UNION ALL SELECT 1 AS is_anomaly, 1 AS synthetic, target - pos AS n FROM t WHERE target > pos"""


def smote_parity(spark, sf):
    out = balance.smote_to_parity(labelled(spark, sf), "is_anomaly", "event_id", ["value", "k"], seed=5)
    # new rows lie between minority rows, whose values exceed 120
    inside = (F.col("synthetic") == 0) | (F.col("value") > 120)
    return out.groupBy("is_anomaly").agg(F.count(F.lit(1)).alias("n"), F.every(inside).alias("low_ok"))


PARITY_SQL = f"SELECT is_anomaly, (SELECT count(*) FROM ({LABELLED_SQL}) WHERE is_anomaly = 0) AS n, TRUE AS low_ok FROM (SELECT 0 AS is_anomaly UNION ALL SELECT 1)"


def batch(spark, sf):
    rows = balance.alternating_batch(labelled(spark, sf), "is_anomaly", ["event_id"], 512, step=1, seed=2)
    return rows.groupBy((F.col("slot") % 2).alias("side"), "is_anomaly").agg(F.count(F.lit(1)).alias("n"))


def weights(spark, sf):
    return rounded(balance.class_weights(labelled(spark, sf), "is_anomaly"))


WEIGHTS_SQL = f"""
SELECT neg, pos, round((neg + pos) / (2 * neg), 6) AS w0, round((neg + pos) / (2 * pos), 6) AS w1, round(ln(pos / neg), 6) AS bias, round(neg / pos, 6) AS ratio
FROM (SELECT count(*) FILTER (WHERE is_anomaly = 0) AS neg, count(*) FILTER (WHERE is_anomaly = 1) AS pos FROM ({LABELLED_SQL}))"""


def target_encoded(spark, sf):
    train, test, _ = orders(spark, sf)
    return rounded(encode.target_encode(train, test, "o_custkey", "target").select("o_orderkey", F.col("o_custkey").alias("code")))


TARGET_SQL = f"""
SELECT o_orderkey, round(coalesce(code, 0), 6) AS code FROM {ORDERS} o LEFT JOIN (
  SELECT o_custkey, (sum(target) + any_value(p) * 20) / (count(*) + 20) AS code FROM {ORDERS}, (SELECT avg(target) AS p FROM {ORDERS} WHERE {TRAIN_SQL}) WHERE {TRAIN_SQL} GROUP BY o_custkey) c USING (o_custkey)
WHERE {TEST_SQL}"""


def evidence_encoded(spark, sf):
    train, test, _ = orders(spark, sf)
    return rounded(encode.evidence_encode(train, test, "o_custkey", "target").select("o_orderkey", F.col("o_custkey").alias("code")))


EVIDENCE_SQL = f"""
SELECT o_orderkey, round(coalesce(code, 0), 6) AS code FROM {ORDERS} o LEFT JOIN (
  SELECT o_custkey, ln((count(*) FILTER (WHERE target = 1) + 1) / (any_value(p) + 2)) - ln((count(*) FILTER (WHERE target = 0) + 1) / (any_value(n) + 2)) AS code
  FROM {ORDERS}, (SELECT count(*) FILTER (WHERE target = 1) AS p, count(*) FILTER (WHERE target = 0) AS n FROM {ORDERS} WHERE {TRAIN_SQL}) WHERE {TRAIN_SQL} GROUP BY o_custkey) c USING (o_custkey)
WHERE {TEST_SQL}"""


def hashed(spark, sf):
    _, _, o = orders(spark, sf)
    return encode.hash_encode(o.select("o_orderkey", "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])


def base_n(spark, sf):
    train, test, _ = orders(spark, sf)
    return encode.base_n_encode(train, test.select("o_orderkey", "o_orderpriority"), "o_orderpriority", 2)


_CODE = f"(SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) AS c FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE {TRAIN_SQL}))"
BASE_N_SQL = f"SELECT o_orderkey, {', '.join(f'CAST((c >> {2 - i}) & 1 AS INTEGER) AS o_orderpriority_{i}' for i in range(3))} FROM orders JOIN {_CODE} USING (o_orderpriority) WHERE {TEST_SQL}"


def one_hot(spark, sf):
    train, test, _ = orders(spark, sf)
    return encode.one_hot(train, test.select("o_orderkey", "o_orderstatus"), "o_orderstatus")


def one_hot_cells(spark, sf):
    """More categories than columns can be: every order line is one."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return encode.one_hot_cells(rows, rows, "line")


CELLS_SQL = """
SELECT l_orderkey, l_linenumber, CASE WHEN c > 1 THEN (c - 2)::INTEGER END AS position, (count(DISTINCT c) OVER () - 1)::INTEGER AS size
FROM (SELECT l_orderkey, l_linenumber, dense_rank() OVER (ORDER BY l_orderkey * 10 + l_linenumber) AS c FROM lineitem)"""


def rare(spark, sf):
    train, test, _ = orders(spark, sf)
    rows = encode.replace_rare(train.withColumn("c", F.col("o_custkey").cast("string")), test.select("o_orderkey", F.col("o_custkey").cast("string").alias("c")), "c", "o_orderkey", 0.0008)
    return rows.select("o_orderkey", "c")


RARE_SQL = f"""
SELECT o_orderkey, c FROM (SELECT o_orderkey, o_custkey FROM orders WHERE {TEST_SQL}) LEFT JOIN (
  SELECT o_custkey, CASE WHEN count(*) < 0.0008::DOUBLE * (SELECT count(*) FROM orders WHERE {TRAIN_SQL}) THEN 'other' ELSE CAST(o_custkey AS VARCHAR) END AS c FROM orders WHERE {TRAIN_SQL} GROUP BY o_custkey) USING (o_custkey)"""


def category_difference(spark, sf):
    train, test, _ = orders(spark, sf)
    return rounded(encode.category_difference(train, test, "o_custkey", "o_totalprice").select("o_orderkey", "o_custkey_cat_diff"))


CAT_DIFF_SQL = f"""
SELECT o_orderkey, round(o_totalprice - m, 6) AS o_custkey_cat_diff FROM (SELECT * FROM orders WHERE {TEST_SQL})
LEFT JOIN (SELECT o_custkey, avg(o_totalprice) AS m FROM orders WHERE {TRAIN_SQL} GROUP BY o_custkey) USING (o_custkey)"""


def derived(spark, sf):
    _, _, o = orders(spark, sf)
    o = encode.interaction(o, "o_orderstatus", "o_orderpriority")
    o = encode.derive(o, "share", "o_totalprice", "o_custkey", lambda a, b: F.try_divide(a, b))
    return o.select("o_orderkey", "o_orderstatus_o_orderpriority", "share")


def scaled(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice")
    a, b = normalize.min_max(rows.where("l_shipdate < '1999-01-01'"), [rows.where("l_shipdate >= '1999-01-01'")], ["l_quantity", "l_extendedprice"])
    return rounded(a.unionByName(b).drop("l_shipdate"))


SCALED_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - a) / (b - a), 6) AS l_quantity, round((l_extendedprice - c) / (d - c), 6) AS l_extendedprice FROM lineitem,
  (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')"""


def zscores(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return rounded(normalize.zscore_per_group(rows, ["l_suppkey"], ["l_quantity", "l_extendedprice"]))


ZSCORES_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce((l_quantity - avg(l_quantity) OVER g) / nullif(stddev_samp(l_quantity) OVER g, 0), 0), 6) AS l_quantity,
  round(coalesce((l_extendedprice - avg(l_extendedprice) OVER g) / nullif(stddev_samp(l_extendedprice) OVER g, 0), 0), 6) AS l_extendedprice
FROM lineitem WINDOW g AS (PARTITION BY l_suppkey)"""


def nearest(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = neighbors.nearest(e, e, "vec_id", "vec_id", "embedding", "embedding", 5, exclude_same=True, pivots=16)
    return rows.select("vec_id", "near_vec_id", "rank", F.round("distance", 5).alias("distance"))


_D = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_PAIRS = f"SELECT a.vec_id, b.vec_id AS near_vec_id, b.label AS near_label, {_D} AS distance, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_D}, b.vec_id) AS INTEGER) AS rank"
NEAREST_SQL = f"SELECT vec_id, near_vec_id, rank, round(distance, 5) AS distance FROM ({_PAIRS} FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE rank <= 5"


def knn(spark, sf):
    e = table(spark, sf, "embeddings")
    held = F.pmod(F.col("vec_id"), F.lit(5)) == 0
    return neighbors.knn_classify(e.where(held), e.where(~held), "vec_id", "vec_id", "embedding", "label", 5)


KNN_SQL = f"""
SELECT vec_id, arg_max(near_label, (n, -near_label)) AS predicted FROM (
  SELECT vec_id, near_label, count(*) AS n FROM ({_PAIRS} FROM embeddings a, embeddings b WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0) WHERE rank <= 5 GROUP BY ALL) GROUP BY vec_id"""


QUERIES = [
    Query("ordered_split", ordered_split, ORDERED_SQL),
    Query("stratified_split_counts", stratified, STRATIFIED_SQL),
    Query("contiguous_folds", contiguous, CONTIGUOUS_SQL),
    Query("stratified_series_folds", series_folds, SERIES_FOLDS_SQL),
    Query("window_split", window_split, WINDOW_SPLIT_SQL),
    Query("normal_window_split", normal_windows, NORMAL_WINDOWS_SQL),
    Query("constant_label", lambda spark, sf: events(spark, sf).select("event_id", "value", F.lit(0).alias("is_anomaly")), "SELECT event_id, value, 0 AS is_anomaly FROM events"),
    Query("shuffled_rows", lambda spark, sf: balance.shuffled(labelled(spark, sf).select("event_id", "is_anomaly"), ["event_id"], seed=5), f"SELECT event_id, is_anomaly FROM ({LABELLED_SQL})"),
    Query("hidden_labels", hidden, HIDDEN_SQL),
    Query("replicate_positives", replicated, REPLICATED_SQL),
    Query("synthetic_and_undersampled", smote, SMOTE_SQL),
    Query("synthetic_to_parity", smote_parity, PARITY_SQL),
    Query("alternating_batch", batch, "SELECT * FROM (VALUES (0::BIGINT, 0, 256::BIGINT), (1::BIGINT, 1, 256::BIGINT)) t(side, is_anomaly, n)"),
    Query("class_weights", weights, WEIGHTS_SQL),
    Query("target_encoding", target_encoded, TARGET_SQL),
    Query("evidence_encoding", evidence_encoded, EVIDENCE_SQL),
    Query("hash_encoding", hashed),
    Query("base_n_encoding", base_n, BASE_N_SQL),
    Query("one_hot_cells", one_hot_cells, CELLS_SQL),
    Query("one_hot_encoding", one_hot, f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS \"o_orderstatus_O\", CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS \"o_orderstatus_P\" FROM orders WHERE {TEST_SQL}"),
    Query("rare_categories", rare, RARE_SQL),
    Query("category_mean_difference", category_difference, CAT_DIFF_SQL),
    Query("derived_columns", derived, "SELECT o_orderkey, o_orderstatus || o_orderpriority AS o_orderstatus_o_orderpriority, o_totalprice / nullif(o_custkey, 0) AS share FROM orders"),
    Query("min_max_by_train", scaled, SCALED_SQL),
    Query("zscore_per_machine", zscores, ZSCORES_SQL),
    Query("nearest_neighbours", nearest, NEAREST_SQL),
    Query("knn_classifier", knn, KNN_SQL),
]
