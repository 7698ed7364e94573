"""Service metrics from raw metric events (key columns, timestamp, metric_name, value, tags)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metric and tag names of the raw events.
REQUESTS = "requests_total"
RESPONSE_TIME = "response_time_nanoseconds_total"
IN_PROGRESS = "inprogress_requests"
ENTRY_TAG = "src.entry_point.resource"
POSITION_TAG = "src.position"
WINDOW_TAG = "timeWindow"
STATUS_TAG = "http.status_code_group"
# Limits of the suitability gate.
MIN_ROWS = 10
RECENT_DAYS = 30
MAX_PIVOT_VALUES = 10_000

KEYS = ("app_id", "version")


def tag(name: str) -> Column:
    return F.col("tags")[name]


def entry_points() -> Column:
    return tag(ENTRY_TAG) == "true"


def responses_of(connector: str) -> Column:
    return (tag("action") == "respond") & (tag("connector_name") == connector)


def is_error_status(status: Column) -> Column:
    return status.isNotNull() & (status != "2xx") & (status != "1xx")


def recent_apps(df: DataFrame, as_of: Column, days: int = RECENT_DAYS, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct keys seen strictly after ``as_of`` - ``days``."""
    return df.where(F.col("timestamp") > as_of - F.make_dt_interval(F.lit(days))).select(*keys).distinct()


def raw_extract(df: DataFrame, match: dict[str, object]) -> DataFrame:
    """All events of one key."""
    for k, v in match.items():
        df = df.where(F.col(k) == F.lit(v))
    return df


def count_matching(df: DataFrame, **equal) -> DataFrame:
    """``count(*)`` for equal values, passed as bound parameters."""
    where = " AND ".join(f"`{k}` = :{k}" for k in equal)
    return df.sparkSession.sql(f"SELECT count(*) AS n FROM {{t}} WHERE {where}", args=equal, t=df)


def request_totals(df: DataFrame, keys: Sequence[str] = KEYS, by: Sequence[str] = (), name: str = "requests_total") -> DataFrame:
    """Sum of request counts by timestamp and reporting window (milliseconds)."""
    window = tag(WINDOW_TAG).try_cast("int").alias("time_window")
    return df.where(F.col("metric_name") == REQUESTS).groupBy(*keys, "timestamp", window, *by).agg(F.sum("value").alias(name))


def metric_total(df: DataFrame, metric: str, name: str, keys: Sequence[str] = KEYS, by: Sequence = ()) -> DataFrame:
    return df.where(F.col("metric_name") == metric).groupBy(*keys, "timestamp", *by).agg(F.sum("value").alias(name))


def _average_ms(total: Column, requests: Column) -> Column:
    return F.try_divide(total, requests) / 1_000_000


def _per_second(requests: Column, window_ms: Column) -> Column:
    return F.try_divide(requests, window_ms) * 1000


def _entry_side(df: DataFrame, keys: Sequence[str], extra: dict[str, Column]) -> DataFrame:
    """Per (keys, timestamp): list of (window, requests) and conditional sums, in one pass.

    Pre-aggregated by window, then by timestamp; both levels combine map-side.
    """
    requests = entry_points() & (F.col("metric_name") == REQUESTS)
    window = F.when(requests, F.struct(tag(WINDOW_TAG).try_cast("int").alias("w"))).alias("_w")
    fine = df.groupBy(*keys, "timestamp", window).agg(
        F.sum(F.when(requests, F.col("value"))).alias("_req"),
        F.sum(F.when(entry_points() & (F.col("metric_name") == RESPONSE_TIME), F.col("value"))).alias("_rt"),
        *[x.alias(n) for n, x in extra.items()],
    )
    return fine.groupBy(*keys, "timestamp").agg(
        F.sort_array(F.collect_list(F.when(F.col("_w").isNotNull(), F.struct(F.col("_w.w").alias("w"), F.col("_req").alias("r"))))).alias("_reqs"),
        F.sum("_rt").alias("_rt"),
        *[F.sum(n).alias(n) for n in extra],
    )


def _expand(rows: DataFrame, prefix: str = "") -> DataFrame:
    """One row per pair (average from window i, throughput from window j) as the chain of left
    outer joins on the timestamp gives; a single row when each timestamp has one window."""
    none = F.array(F.lit(None).cast("double"))
    has = F.size("_reqs") > 0
    avg = F.when(F.col("_rt").isNotNull() & has, F.transform("_reqs", lambda x: _average_ms(F.col("_rt"), x["r"])))
    thr = F.when(has, F.transform("_reqs", lambda x: _per_second(x["r"], x["w"])))
    rows = rows.withColumn(f"{prefix}avg_response_time", F.explode(F.coalesce(avg, none)))
    return rows.withColumn(f"{prefix}throughput", F.explode(F.coalesce(thr, none))).drop("_reqs", "_rt")


def app_metrics(df: DataFrame, caller_connector: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """avg_response_time, throughput, http_error_count, service_error_count per key and timestamp.

    Only timestamps with request or response-time events appear (the spine).  Error counts are
    NULL where their side has no event at all.
    """
    caller = responses_of(caller_connector)
    extra = {
        "_spine": F.count_if(F.col("metric_name").isin(REQUESTS, RESPONSE_TIME)),
        "_callers": F.count_if(caller),
        "_http": F.count_if(caller & is_error_status(tag(STATUS_TAG))),
        "_services": F.count_if(entry_points()),
        "_service_errors": F.count_if(entry_points() & (tag("error") == "true")),
    }
    rows = _expand(_entry_side(df, keys, extra).where(F.col("_spine") > 0))
    return rows.select(
        *keys, "timestamp", "avg_response_time", "throughput",
        F.when(F.col("_callers") > 0, F.col("_http")).alias("http_error_count"),
        F.when(F.col("_services") > 0, F.col("_service_errors")).alias("service_error_count"),
    )


def pivot_values(df: DataFrame, column: Column) -> list[str]:
    """Distinct pivot values, refused above a fixed count (they become columns)."""
    found = df.select(column.alias("v")).where(F.col("v").isNotNull()).distinct().limit(MAX_PIVOT_VALUES + 1).collect()
    if len(found) > MAX_PIVOT_VALUES:
        raise ValueError(f"more than {MAX_PIVOT_VALUES} pivot values; pass the wanted ones, or take connection_cells")
    return sorted(r["v"] for r in found)


#: What is measured per outbound call position.
OUTBOUND = ("avg_response_time", "throughput", "inprogress_requests")


def _inbound(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    in_ipr = F.when(entry_points() & (F.col("metric_name") == IN_PROGRESS), F.col("value"))
    extra = {
        "_spine": F.count_if(F.col("metric_name").isin(IN_PROGRESS, REQUESTS, RESPONSE_TIME)),
        "in_ipr": F.sum(in_ipr),
    }
    return _expand(_entry_side(df, keys, extra).where(F.col("_spine") > 0), "in_").drop("_spine")


def _outbound(out_events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key, time and call position."""
    m, position = F.col("metric_name"), tag(POSITION_TAG).alias("position")
    is_requests = m == REQUESTS
    window = F.when(is_requests, tag(WINDOW_TAG).try_cast("int")).alias("_w")
    fine = out_events.groupBy(*keys, "timestamp", position, is_requests.alias("_is_req"), window).agg(
        F.sum(F.when(is_requests, F.col("value"))).alias("_req"),
        F.sum(F.when(m == RESPONSE_TIME, F.col("value"))).alias("_rt"),
        F.sum(F.when(m == IN_PROGRESS, F.col("value"))).alias("_ipr"),
    )
    return fine.groupBy(*keys, "timestamp", "position").agg(
        # sum over windows of rt / requests = rt * sum(1 / requests)
        (F.sum("_rt") * F.sum(F.try_divide(F.lit(1.0), F.col("_req"))) / 1_000_000).alias("avg_response_time"),
        F.sum(_per_second(F.col("_req"), F.col("_w"))).alias("throughput"),
        F.sum("_ipr").alias("inprogress_requests"),
    )


def connection_metrics(
    df: DataFrame, client_connector: str, positions: Sequence[str] | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Inbound averages plus one column group per outbound call position; missing cells are 0."""
    out_events = df.where(tag("connector_name") == client_connector)
    if positions is None:
        positions = pivot_values(out_events, tag(POSITION_TAG))
    cells = [
        F.sum(F.when(F.col("position") == p, F.col(x))).alias(f"out_{x}_{p}")
        for x in OUTBOUND
        for p in positions
    ]
    outbound = _outbound(out_events, keys).groupBy(*keys, "timestamp").agg(*cells)
    joined = _inbound(df, keys).join(outbound, [*keys, "timestamp"], "left")
    return joined.na.fill(0.0)


def connection_cells(df: DataFrame, client_connector: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The pivot as rows, for any number of positions: inbound averages and the outbound ones of one
    position.  A key and time without outbound calls has one row, its position NULL and its cells 0;
    positions that are not there would be 0 in every column."""
    out_events = df.where((tag("connector_name") == client_connector) & tag(POSITION_TAG).isNotNull())
    outbound = _outbound(out_events, keys).withColumnsRenamed({x: f"out_{x}" for x in OUTBOUND})
    return _inbound(df, keys).join(outbound, [*keys, "timestamp"], "left").na.fill(0.0)


def suitability(metrics: DataFrame, apps: DataFrame, keys: Sequence[str] = KEYS, min_rows: int = MIN_ROWS) -> DataFrame:
    """Reason per key: empty, no_throughput, too_few_rows or suitable."""
    sizes = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("throughput").alias("t"))
    return apps.join(sizes, list(keys), "left").select(
        *keys,
        F.when(F.col("n").isNull(), "empty")
        .when(F.col("t") == 0, "no_throughput")
        .when(F.col("n") < min_rows, "too_few_rows")
        .otherwise("suitable")
        .alias("reason"),
    )


def suitability_counts(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("apps"))


def drop_quiet_series(df: DataFrame, keys: Sequence[str], value: str, limit: float = 100.0) -> DataFrame:
    """Drop a series when all its values are below the limit (a NULL keeps the series)."""
    kept = (
        df.groupBy(*keys)
        .agg(F.max(value).alias("_max"), F.count(value).alias("_v"), F.count(F.lit(1)).alias("_n"))
        .where((F.col("_max") >= limit) | (F.col("_v") < F.col("_n")))
        .select(*keys)
    )
    return df.join(kept, list(keys), "left_semi")
