"""Queries over metric events, keys and labels: filters, joins, aggregates, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import scalars as sc
from tidewatch.operators import metrics_query as mq
from tidewatch.operators import profile
from tidewatch.plans.roles import LABELLED_SQL, TAGGED_SQL, Query, labelled, rounded, table, tagged_events

CLIENT, CALLER = "http/Client", "http/Caller"


def metric_events(spark, sf):
    """``events`` as raw metric events: app and version from the user, tags from type and bag."""
    ev = tagged_events(spark, sf)
    t, k, u = F.col("event_type"), F.col("k"), F.col("user_id")
    name = (
        F.when((t == "error") | ((t == "purchase") & (k % 5 == 0)), mq.IN_PROGRESS)
        .when(t.isin("click", "purchase"), mq.REQUESTS).otherwise(mq.RESPONSE_TIME)
    )
    status = F.when(k < 30, "2xx").when(k < 60, "5xx").when(k >= 70, "4xx")
    tags = F.create_map(
        F.lit(mq.WINDOW_TAG), F.when(k < 90, "60000").otherwise("30000"),
        F.lit(mq.ENTRY_TAG), F.when(t.isin("click", "view", "error"), "true").otherwise("false"),
        F.lit("connector_name"), F.when(t.isin("purchase", "signup"), CLIENT).when(t == "error", CALLER),
        F.lit("action"), F.when((t == "error") & (k % 2 == 0), "respond"),
        F.lit(mq.STATUS_TAG), status,
        F.lit("error"), F.when(k % 7 == 0, "true"),
        F.lit(mq.POSITION_TAG), F.concat(F.lit("p"), (u % 3).cast("string")),
    )
    return ev.select(
        F.concat(F.lit("app-"), (u % 20).cast("string")).alias("app_id"), F.concat(F.lit("v"), (u % 2).cast("string")).alias("version"),
        F.date_trunc("day", "ts").alias("timestamp"), name.alias("metric_name"), "value", tags.alias("tags"),
    )


ROLE = f"""SELECT 'app-' || (user_id % 20) AS app_id, 'v' || (user_id % 2) AS version, date_trunc('day', ts)::TIMESTAMP AS timestamp,
  CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND k % 5 = 0) THEN 'inprogress_requests'
       WHEN event_type IN ('click', 'purchase') THEN 'requests_total' ELSE 'response_time_nanoseconds_total' END AS metric_name,
  value, CASE WHEN k < 90 THEN 60000 ELSE 30000 END AS tw, event_type IN ('click', 'view', 'error') AS entry,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'client' WHEN event_type = 'error' THEN 'caller' END AS connector,
  event_type = 'error' AND k % 2 = 0 AS responds, CASE WHEN k < 30 THEN '2xx' WHEN k < 60 THEN '5xx' WHEN k >= 70 THEN '4xx' END AS status,
  k % 7 = 0 AS failed, 'p' || (user_id % 3) AS position
  FROM ({TAGGED_SQL})"""

K = "app_id, version, timestamp"
APP_SQL = f"""
WITH m AS ({ROLE}), svc AS (SELECT * FROM m WHERE entry),
req AS (SELECT {K}, tw, sum(value) AS r FROM svc WHERE metric_name = 'requests_total' GROUP BY ALL),
rt AS (SELECT {K}, sum(value) AS t FROM svc WHERE metric_name = 'response_time_nanoseconds_total' GROUP BY ALL),
av AS (SELECT {K}, t / nullif(r, 0) / 1000000 AS avg_response_time FROM rt LEFT JOIN req USING ({K})),
th AS (SELECT {K}, r / tw * 1000 AS throughput FROM req),
he AS (SELECT {K}, count(*) FILTER (WHERE status IS NOT NULL AND status NOT IN ('2xx', '1xx')) AS http_error_count FROM m WHERE responds AND connector = 'caller' GROUP BY ALL),
se AS (SELECT {K}, count(*) FILTER (WHERE failed) AS service_error_count FROM svc GROUP BY ALL),
spine AS (SELECT DISTINCT {K} FROM m WHERE metric_name IN ('requests_total', 'response_time_nanoseconds_total'))
SELECT {K}, avg_response_time * 1 AS avg_response_time, throughput, http_error_count, service_error_count FROM spine LEFT JOIN av USING ({K}) LEFT JOIN th USING ({K})
  LEFT JOIN he USING ({K}) LEFT JOIN se USING ({K})"""
APP_ROUND = f"SELECT {K}, round(avg_response_time, 9) AS avg_response_time, round(throughput, 6) AS throughput, http_error_count, service_error_count FROM ({APP_SQL})"


def app_metrics(spark, sf):
    rows = mq.app_metrics(metric_events(spark, sf), CALLER)
    return rows.withColumns({"avg_response_time": F.round("avg_response_time", 9), "throughput": F.round("throughput", 6)})


def app_metrics_one_key(spark, sf):
    rows = metric_events(spark, sf).where((F.col("app_id") == "app-3") & (F.col("version") == "v1"))
    rows = mq.app_metrics(rows, CALLER).orderBy("timestamp")
    return rows.withColumns({"avg_response_time": F.round("avg_response_time", 9), "throughput": F.round("throughput", 6)})


POSITIONS = ["p0", "p1", "p2"]


def connection_metrics(spark, sf):
    rows = mq.connection_metrics(metric_events(spark, sf), CLIENT)
    return rounded(rows, 9)


def _cells(x: str) -> str:
    return ", ".join(f"sum(CASE WHEN position = '{p}' THEN {x} END) AS out_{x}_{p}" for p in POSITIONS)


_OUT = [f"out_{x}_{p}" for x in ("avg_response_time", "throughput", "inprogress_requests") for p in POSITIONS]
CONNECTION_SQL = f"""
WITH m AS ({ROLE}), svc AS (SELECT * FROM m WHERE entry), o AS (SELECT * FROM m WHERE connector = 'client'),
req AS (SELECT {K}, tw, sum(value) AS r FROM svc WHERE metric_name = 'requests_total' GROUP BY ALL),
rt AS (SELECT {K}, sum(value) AS t FROM svc WHERE metric_name = 'response_time_nanoseconds_total' GROUP BY ALL),
ipr AS (SELECT {K}, sum(value) AS in_ipr FROM svc WHERE metric_name = 'inprogress_requests' GROUP BY ALL),
av AS (SELECT {K}, t / nullif(r, 0) / 1000000 AS in_avg_response_time FROM rt LEFT JOIN req USING ({K})),
th AS (SELECT {K}, r / tw * 1000 AS in_throughput FROM req),
oreq AS (SELECT {K}, tw, position, sum(value) AS r FROM o WHERE metric_name = 'requests_total' GROUP BY ALL),
ort AS (SELECT {K}, position, sum(value) AS t FROM o WHERE metric_name = 'response_time_nanoseconds_total' GROUP BY ALL),
oipr AS (SELECT {K}, {_cells('inprogress_requests')} FROM (SELECT {K}, position, sum(value) AS inprogress_requests FROM o WHERE metric_name = 'inprogress_requests' GROUP BY ALL) GROUP BY ALL),
oav AS (SELECT {K}, {_cells('avg_response_time')} FROM (SELECT {K}, position, t / nullif(r, 0) / 1000000 AS avg_response_time FROM ort LEFT JOIN oreq USING ({K}, position)) GROUP BY ALL),
oth AS (SELECT {K}, {_cells('throughput')} FROM (SELECT {K}, position, r / tw * 1000 AS throughput FROM oreq) GROUP BY ALL),
spine AS (SELECT DISTINCT {K} FROM m WHERE metric_name IN ('inprogress_requests', 'requests_total', 'response_time_nanoseconds_total'))
SELECT {K}, {', '.join(f'round(coalesce({c}, 0), 9) AS {c}' for c in ('in_avg_response_time', 'in_throughput', 'in_ipr', *_OUT))}
FROM spine LEFT JOIN av USING ({K}) LEFT JOIN th USING ({K}) LEFT JOIN ipr USING ({K}) LEFT JOIN oav USING ({K}) LEFT JOIN oth USING ({K}) LEFT JOIN oipr USING ({K})"""


def connection_cells(spark, sf):
    return rounded(mq.connection_cells(metric_events(spark, sf), CLIENT), 9)


_HEAD = CONNECTION_SQL[: CONNECTION_SQL.index("oipr AS")]
CELLS_SQL = _HEAD + f"""
oav AS (SELECT {K}, position, sum(t / nullif(r, 0) / 1000000) AS out_avg_response_time FROM ort LEFT JOIN oreq USING ({K}, position) GROUP BY ALL),
oth AS (SELECT {K}, position, sum(r / tw * 1000) AS out_throughput FROM oreq GROUP BY ALL),
oipr AS (SELECT {K}, position, sum(value) AS out_inprogress_requests FROM o WHERE metric_name = 'inprogress_requests' GROUP BY ALL),
places AS (SELECT DISTINCT {K}, position FROM o WHERE position IS NOT NULL),
cells AS (SELECT * FROM places LEFT JOIN oav USING ({K}, position) LEFT JOIN oth USING ({K}, position) LEFT JOIN oipr USING ({K}, position)),
spine AS (SELECT DISTINCT {K} FROM m WHERE metric_name IN ('inprogress_requests', 'requests_total', 'response_time_nanoseconds_total'))
SELECT {K}, position, {', '.join(f'round(coalesce({c}, 0), 9) AS {c}' for c in ('in_avg_response_time', 'in_throughput', 'in_ipr', *[f'out_{x}' for x in mq.OUTBOUND]))}
FROM spine LEFT JOIN av USING ({K}) LEFT JOIN th USING ({K}) LEFT JOIN ipr USING ({K}) LEFT JOIN cells USING ({K})"""


def recent_apps(spark, sf):
    return mq.recent_apps(metric_events(spark, sf), F.lit("2024-02-20").cast("timestamp"))


def suitability(spark, sf):
    ev = metric_events(spark, sf)
    # drop some apps' entry points, so that every reason occurs
    ev = ev.where(~((F.col("app_id") == "app-1") & F.col("metric_name").isin(mq.REQUESTS, mq.RESPONSE_TIME)))
    ev = ev.where(~((F.col("app_id") == "app-2") & (F.col("metric_name") == mq.REQUESTS)))
    ev = ev.where(~((F.col("app_id") == "app-3") & (F.col("timestamp") > "2024-01-05")))
    return mq.suitability_counts(mq.suitability(mq.app_metrics(ev, CALLER), ev.select("app_id", "version").distinct()))


SUIT_ROLE = f"""SELECT * FROM ({ROLE}) WHERE NOT (app_id = 'app-1' AND metric_name IN ('requests_total', 'response_time_nanoseconds_total'))
  AND NOT (app_id = 'app-2' AND metric_name = 'requests_total') AND NOT (app_id = 'app-3' AND timestamp > TIMESTAMP '2024-01-05')"""
SUIT_SQL = f"""
SELECT reason, count(*) AS apps FROM (
  SELECT CASE WHEN n IS NULL THEN 'empty' WHEN t = 0 THEN 'no_throughput' WHEN n < 10 THEN 'too_few_rows' ELSE 'suitable' END AS reason
  FROM (SELECT DISTINCT app_id, version FROM ({SUIT_ROLE}))
  LEFT JOIN (SELECT app_id, version, count(*) AS n, count(throughput) AS t FROM ({APP_SQL.replace(ROLE, SUIT_ROLE)}) GROUP BY ALL) USING (app_id, version))
GROUP BY reason"""


def request_totals(spark, sf):
    return rounded(mq.request_totals(metric_events(spark, sf).where(mq.entry_points())))


def response_totals(spark, sf):
    return rounded(mq.metric_total(metric_events(spark, sf), mq.RESPONSE_TIME, "response_time_total"))


def totals_by_position(spark, sf):
    out = metric_events(spark, sf).where(mq.tag("connector_name") == CLIENT)
    return rounded(mq.request_totals(out, by=[mq.tag(mq.POSITION_TAG).alias("position")], name="out_requests_total"))


def quiet_series(spark, sf):
    ev = tagged_events(spark, sf).withColumn("day", F.to_date("ts")).withColumn("value", F.when(F.col("k") != 13, F.col("value")))
    rows = mq.drop_quiet_series(ev, ["user_id", "day"], "value", 100.0)
    return rows.select("event_id", "user_id", "day", "value")


QUIET_SQL = f"""
SELECT event_id, user_id, day, value FROM (
  SELECT *, max(value) OVER g AS m, count(value) OVER g AS c, count(*) OVER g AS n FROM (
    SELECT event_id, user_id, CAST(ts AS DATE) AS day, CASE WHEN k <> 13 THEN value END AS value FROM ({TAGGED_SQL}))
  WINDOW g AS (PARTITION BY user_id, day)) WHERE m >= 100 OR c < n"""


def count_orders(spark, sf):
    return mq.count_matching(table(spark, sf, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT")


def key_extract(spark, sf):
    return mq.raw_extract(tagged_events(spark, sf).select("event_id", "user_id", "event_type", "value"), {"user_id": 7, "event_type": "view"})


def error_counts(spark, sf):
    ev = metric_events(spark, sf)
    status = mq.tag(mq.STATUS_TAG)
    return ev.groupBy("app_id").agg(
        F.count_if(mq.is_error_status(status)).alias("http_errors"), F.count_if(mq.tag("error") == "true").alias("service_errors"),
        F.count_if(status.isNotNull()).alias("with_status"),
    )


def range_rows(spark, sf):
    return profile.column_ranges(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_quantity", "l_extendedprice", "l_discount"])


RANGE_SQL = " UNION ALL ".join(
    f"SELECT l_suppkey, '{c}' AS metric, min({c}) AS low, max({c}) AS high, CAST(round_even(min({c}), 2) AS VARCHAR) || '-' || CAST(round_even(max({c}), 2) AS VARCHAR) AS text FROM lineitem GROUP BY l_suppkey"
    for c in ("l_quantity", "l_extendedprice", "l_discount")
)


def overall_ranges(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return profile.overall_ranges(profile.column_ranges(table(spark, sf, "lineitem"), ["l_linestatus", "l_suppkey"], cols), ["l_linestatus"], cols)


OVERALL_SQL = "SELECT l_linestatus, " + ", ".join(
    f"CAST(round_even(min({c}), 2) AS VARCHAR) || '-' || CAST(round_even(max({c}), 2) AS VARCHAR) AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount")
) + " FROM lineitem GROUP BY l_linestatus"


def described(spark, sf):
    return rounded(profile.describe(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


DESCRIBE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
    round(quantile_cont({c}, 0.25::DOUBLE), 6) AS p25, round(quantile_cont({c}, 0.5::DOUBLE), 6) AS p50, round(quantile_cont({c}, 0.75::DOUBLE), 6) AS p75 FROM lineitem"""
    for c in ("l_quantity", "l_extendedprice", "l_discount")
)


def _gappy(spark, sf):
    ev = tagged_events(spark, sf)
    return ev.select(
        "event_id", F.when(F.col("k") == 3, None).otherwise(F.col("value")).alias("value"),
        F.when(F.col("value") > 200, F.lit(float("nan"))).otherwise(F.col("k").cast("double")).alias("k"), "user_id",
    )


GAPPY = f"SELECT event_id, CASE WHEN k <> 3 THEN value END AS value, CASE WHEN value <= 200 THEN k END AS k, user_id FROM ({TAGGED_SQL})"


def null_profile(spark, sf):
    return profile.null_profile(_gappy(spark, sf), ["value", "k", "user_id"])


NULL_SQL = f"""
SELECT count(*) AS rows, count(*) FILTER (WHERE value IS NULL OR k IS NULL OR user_id IS NULL) AS null_rows,
  array_to_string(list_sort(list_filter([CASE WHEN count(*) > count(value) THEN 'value' END, CASE WHEN count(*) > count(k) THEN 'k' END, CASE WHEN count(*) > count(user_id) THEN 'user_id' END], lambda x: x IS NOT NULL)), ',') AS null_columns,
  count(*) FILTER (WHERE value IS NULL OR k IS NULL OR user_id IS NULL) > 1 AS found FROM ({GAPPY})"""


def null_positions(spark, sf):
    return profile.null_positions(_gappy(spark, sf), "event_id", ["value", "k"])


NULL_POS_SQL = f"SELECT event_id, 'value' AS \"column\" FROM ({GAPPY}) WHERE value IS NULL UNION ALL SELECT event_id, 'k' AS \"column\" FROM ({GAPPY}) WHERE k IS NULL"


def drift(spark, sf):
    o = table(spark, sf, "orders")
    train, test = o.where(F.col("o_orderdate") < "2000-01-01"), o.where(F.col("o_orderdate") >= "2000-01-01")
    train = train.where(F.col("o_orderpriority") != "5-LOW")
    cols = ["o_totalprice", "o_orderstatus", "o_orderpriority", "o_custkey"]
    return profile.drift_report(train, test, cols)


_DR = "SELECT '{c}' AS \"column\", min({c}) FILTER (WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderpriority <> '5-LOW')::DOUBLE AS train_min, max({c}) FILTER (WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderpriority <> '5-LOW')::DOUBLE AS train_max, min({c}) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01')::DOUBLE AS test_min, max({c}) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-01-01')::DOUBLE AS test_max, NULL::VARCHAR AS new_value FROM orders"
_DN = "SELECT '{c}' AS \"column\", NULL::DOUBLE AS train_min, NULL::DOUBLE AS train_max, NULL::DOUBLE AS test_min, NULL::DOUBLE AS test_max, {c} AS new_value FROM (SELECT DISTINCT {c} FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' EXCEPT SELECT {c} FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' AND o_orderpriority <> '5-LOW')"
DRIFT_SQL = " UNION ALL ".join([_DR.format(c="o_totalprice"), _DN.format(c="o_orderstatus"), _DN.format(c="o_orderpriority"), _DR.format(c="o_custkey")])


def scalar_columns(spark, sf):
    ev = tagged_events(spark, sf)
    low, high = sc.split_range(F.concat(F.round(-F.col("value"), 2).cast("string"), F.lit("-"), F.col("k").cast("string")))
    app, version = sc.split_key(F.concat(F.lit("svc|v"), F.col("user_id").cast("string"), F.lit(".csv")))
    word = F.when(F.col("k") < 10, "Attack").when(F.col("k") < 20, "A ttack").otherwise("Normal")
    return ev.select(
        "event_id", sc.zero_guard(F.when(F.col("k") == 0, 0.0).otherwise(F.col("value"))).alias("guarded"),
        sc.attack_flag(word).alias("attack"), sc.decimal_comma(F.regexp_replace(F.col("value").cast("string"), r"\.", ",")).alias("number"),
        sc.to_number(F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise("n/a")).alias("coerced"),
        sc.cross_category(F.col("event_type"), F.col("k")).alias("crossed"), low.alias("low"), high.alias("high"), app.alias("app"), version.alias("version"),
        sc.day_index_to_date(F.col("k")).alias("day"), sc.round_flag(F.col("k") / 2).alias("half_even"),
        sc.magnitude_flag((F.col("k") - 50) / 20).alias("far"), sc.above(F.col("value"), 95.0).alias("high_flag"),
        F.round(sc.finite_or(F.when(F.col("k") == 5, float("inf")).otherwise(F.col("value")), 10000.0), 6).alias("finite"),
    )


SCALAR_SQL = f"""
SELECT event_id, CASE WHEN k = 0 THEN 0.01::DOUBLE ELSE value END AS guarded, CASE WHEN k < 20 THEN 1 ELSE 0 END AS attack, value AS number,
  CASE WHEN k % 2 = 0 THEN k::DOUBLE END AS coerced, event_type || k AS crossed, round(-value, 2) AS low, k::DOUBLE AS high, 'svc' AS app, 'v' || user_id AS version,
  CAST(DATE '2020-01-01' + k AS DATE) AS day, CAST(round_even(k / 2.0::DOUBLE, 0) AS INTEGER) AS half_even, CASE WHEN abs((k - 50) / 20.0::DOUBLE) >= 1.96 THEN 1 ELSE 0 END AS far,
  CASE WHEN value > 95 THEN 1 ELSE 0 END AS high_flag, CASE WHEN k = 5 THEN 10000.0::DOUBLE ELSE round(value, 6) END AS finite FROM ({TAGGED_SQL})"""


def outcome_columns(spark, sf):
    rows = sc.outcome_columns(labelled(spark, sf), "value", "is_anomaly", "predicted")
    return rows.select("event_id", "tp", "fp", "fn", sc.outcome_score(F.col("is_anomaly"), F.col("predicted")).alias("points"))


OUTCOME_SQL = f"""
SELECT event_id, CASE WHEN is_anomaly = 1 AND predicted = 1 THEN value ELSE -0.5::DOUBLE END AS tp, CASE WHEN is_anomaly = 0 AND predicted = 1 THEN value ELSE -0.5::DOUBLE END AS fp,
  CASE WHEN is_anomaly = 1 AND predicted = 0 THEN value ELSE -0.5::DOUBLE END AS fn,
  CASE WHEN is_anomaly = 1 AND predicted = 1 THEN 5 WHEN is_anomaly = 0 AND predicted = 1 THEN -3 WHEN is_anomaly = 1 THEN -6 ELSE 0 END AS points FROM ({LABELLED_SQL})"""


def replaced_infinity(spark, sf):
    from tidewatch.operators.normalize import replace_inf_with_max

    rows = tagged_events(spark, sf).select("event_id", F.when(F.col("k") == 9, float("inf")).otherwise(F.col("value")).alias("value"))
    return replace_inf_with_max(rows, ["value"])


def pairs(spark, sf):
    rows = labelled(spark, sf).withColumn("day", F.dayofmonth("ts"))
    return profile.feature_pairs(rows, "event_id", "is_anomaly", ["value", "k", "score", "day"]).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


_PF = [("value", "value"), ("k", "k::DOUBLE"), ("score", "score"), ("day", "day(ts)::DOUBLE")]
PAIRS_SQL = " UNION ALL ".join(
    f"SELECT event_id, is_anomaly, '{a}' AS x_name, '{b}' AS y_name, round({ea}, 6) AS x, round({eb}, 6) AS y FROM ({LABELLED_SQL})"
    for i, (a, ea) in enumerate(_PF) for b, eb in _PF[i + 1:]
)


def taxonomy(spark, sf):
    from tidewatch.series import small

    ev = tagged_events(spark, sf)
    dim = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("category"))
    kept = ev.join(small(dim.where(F.col("category") == "BUILDING"), dim.count()), "user_id")
    return kept.select("event_id", "user_id", "category", "value")


QUERIES = [
    Query("app_metrics_all", app_metrics, APP_ROUND),
    Query("app_metrics_one_key", app_metrics_one_key, f"SELECT * FROM ({APP_ROUND}) WHERE app_id = 'app-3' AND version = 'v1'"),
    Query("connection_metrics_pivot", connection_metrics, CONNECTION_SQL),
    Query("connection_metrics_cells", connection_cells, CELLS_SQL),
    Query("recent_distinct_apps", recent_apps, f"SELECT DISTINCT app_id, version FROM ({ROLE}) WHERE timestamp > TIMESTAMP '2024-01-21'"),
    Query("suitability_reasons", suitability, SUIT_SQL),
    Query("request_totals_by_window", request_totals, f"SELECT {K}, tw AS time_window, round(sum(value), 6) AS requests_total FROM ({ROLE}) WHERE entry AND metric_name = 'requests_total' GROUP BY ALL"),
    Query("metric_totals", response_totals, f"SELECT {K}, round(sum(value), 6) AS response_time_total FROM ({ROLE}) WHERE metric_name = 'response_time_nanoseconds_total' GROUP BY ALL"),
    Query("totals_by_position", totals_by_position, f"SELECT {K}, tw AS time_window, position, round(sum(value), 6) AS out_requests_total FROM ({ROLE}) WHERE connector = 'client' AND metric_name = 'requests_total' GROUP BY ALL"),
    Query("conditional_error_counts", error_counts, f"SELECT app_id, count(*) FILTER (WHERE status NOT IN ('2xx', '1xx')) AS http_errors, count(*) FILTER (WHERE failed) AS service_errors, count(status) AS with_status FROM ({ROLE}) GROUP BY app_id"),
    Query("drop_quiet_series", quiet_series, QUIET_SQL),
    Query("count_by_bound_values", count_orders, "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    Query("key_extract", key_extract, "SELECT event_id, user_id, event_type, value FROM events WHERE user_id = 7 AND event_type = 'view'"),
    Query("column_ranges", range_rows, RANGE_SQL),
    Query("overall_ranges", overall_ranges, OVERALL_SQL),
    Query("summary_statistics", described, DESCRIBE_SQL),
    Query("null_profile", null_profile, NULL_SQL),
    Query("null_positions", null_positions, NULL_POS_SQL),
    Query("train_test_drift", drift, DRIFT_SQL),
    Query("group_counts", lambda s, d: profile.group_counts(table(s, d, "lineitem"), "l_suppkey", "l_quantity"), "SELECT l_suppkey, count(l_quantity) AS count FROM lineitem GROUP BY l_suppkey"),
    Query("top_ten_keys", lambda s, d: profile.top_keys(table(s, d, "lineitem"), "l_suppkey", "l_quantity"), "SELECT l_suppkey, count(l_quantity) AS count FROM lineitem GROUP BY l_suppkey ORDER BY count DESC, l_suppkey LIMIT 10"),
    Query(
        "rows_of_top_keys", lambda s, d: profile.rows_of_top_keys(table(s, d, "lineitem"), "l_suppkey", "l_quantity").select("l_orderkey", "l_suppkey", "l_quantity"),
        "SELECT l_orderkey, l_suppkey, l_quantity FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY count(l_quantity) DESC, l_suppkey LIMIT 10)",
    ),
    Query("class_balance", lambda s, d: profile.class_balance(labelled(s, d), "is_anomaly"), f"SELECT is_anomaly, count(*) AS count FROM ({LABELLED_SQL}) GROUP BY is_anomaly"),
    Query(
        "values_new_in_test",
        lambda s, d: profile.new_values(table(s, d, "events").where("ts < '2024-01-10'"), table(s, d, "events").where("ts >= '2024-01-10'"), "props"),
        "SELECT DISTINCT props FROM events WHERE ts >= TIMESTAMP '2024-01-10' EXCEPT SELECT props FROM events WHERE ts < TIMESTAMP '2024-01-10'",
    ),
    Query("scalar_functions", scalar_columns, SCALAR_SQL),
    Query("outcome_columns", outcome_columns, OUTCOME_SQL),
    Query("infinity_to_max", replaced_infinity, f"SELECT event_id, CASE WHEN k = 9 THEN (SELECT max(value) FROM ({TAGGED_SQL}) WHERE k <> 9) ELSE value END AS value FROM ({TAGGED_SQL})"),
    Query("feature_pairs", pairs, PAIRS_SQL),
    Query("series_taxonomy", taxonomy, "SELECT event_id, user_id, c_mktsegment AS category, value FROM events JOIN customer ON c_custkey = user_id WHERE c_mktsegment = 'BUILDING'"),
]
