"""How the given tables play the roles of the data model, in Spark and in SQL.

``events`` holds many univariate series (``event_type`` or ``user_id``), in ``ts, event_id`` order;
its ``props`` bag plays the tag map.  Labels and scores of events are simple functions of the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.scalars import record_tags
from tidewatch.series import SeriesSpec

TYPE = SeriesSpec(("event_type",), ("ts", "event_id"))
USER = SeriesSpec(("user_id",), ("ts", "event_id"))
ALL = SeriesSpec((), ("ts", "event_id"))


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tagged_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).withColumn("tags", record_tags(F.col("props")))
    return rows.withColumn("k", F.col("tags")["k"].cast("int"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a label, a score in [0, 1] and a 0/1 prediction."""
    rows = tagged_events(spark, sf)
    score = (F.col("k") + F.floor(F.least(F.col("value"), F.lit(100.0)))) / 200
    return rows.select(
        "event_id", "ts", "user_id", "event_type", "value", "k",
        F.when(F.col("value") > 120, 1).otherwise(0).alias("is_anomaly"),
        score.alias("score"),
        F.when(score > 0.6, 1).otherwise(0).alias("predicted"),
    )


# The same rows in SQL.
TAGGED_SQL = "SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events"
LABELLED_SQL = f"""
SELECT *, CASE WHEN score > 0.6 THEN 1 ELSE 0 END AS predicted FROM (
  SELECT *, CASE WHEN value > 120 THEN 1 ELSE 0 END AS is_anomaly,
         (k + CAST(floor(least(value, 100.0::DOUBLE)) AS BIGINT)) / 200 AS score
  FROM ({TAGGED_SQL}))"""


def rounded(df: DataFrame, digits: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded for comparison; other columns as they are.

    ``rint`` of the scaled value stays in generated code (``round`` on doubles builds decimals);
    adding 0 turns a negative zero into zero.
    """
    scale = 10.0**digits
    out: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.simpleString() == "double" and f.name not in keep:
            c = (F.rint(c * scale) / scale + F.lit(0.0)).alias(f.name)
        out.append(c)
    return df.select(*out)


def rounded_sql(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"round_even({c}, {digits}) AS {c}" for c in columns)


def frame_sql(n: int, part: str = "event_type") -> str:
    return f"(PARTITION BY {part} ORDER BY ts, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def order_sql(part: str = "event_type") -> str:
    return f"(PARTITION BY {part} ORDER BY ts, event_id)"


STATS = ("mean", "std", "kurt", "zscore", "entropy")


def stats_sql(source: str, col: str = "value", prefix: str = "", fallback: bool = True, entropy: bool = True, windows=(5, 25, 50), part: str = "event_type") -> str:
    """SELECT adding the rolling statistics of ``col`` to ``source``."""
    raw, out = [], []
    previous = {"mean": col, "std": "0.0::DOUBLE", "kurt": "0.0::DOUBLE", "zscore": "0.0::DOUBLE", "entropy": "0.0::DOUBLE"}
    for n in windows:
        f = frame_sql(n, part)
        full = f"count({col}) OVER {f} = {n}"
        term = f"CASE WHEN {col} = 0 THEN 0 ELSE abs({col}) * ln(abs({col})) END"
        now = {
            "mean": f"avg({col}) OVER {f}",
            "std": f"stddev_samp({col}) OVER {f}",
            "kurt": f"kurtosis({col}) OVER {f}",
            "zscore": f"({col} - avg({col}) OVER {f}) / nullif(stddev_pop({col}) OVER {f}, 0)",
            "entropy": (
                f"CASE WHEN (min({col}) OVER {f} >= 0 OR max({col}) OVER {f} <= 0) AND sum({col}) OVER {f} <> 0 "
                f"THEN ln(abs(sum({col}) OVER {f})) - (sum({term}) OVER {f}) / abs(sum({col}) OVER {f}) ELSE 10000 END"
            ),
        }
        for s in STATS if entropy else STATS[:4]:
            name = f"{prefix}value_w{n}_{s}"
            raw.append(f"CASE WHEN {full} THEN {now[s]} END AS r_{name}")
            value = f"coalesce(r_{name}, {previous[s]})" if fallback else f"r_{name}"
            out.append(f"{value} AS {name}")
            previous[s] = value
    drop = ", ".join(x.split(" AS ")[-1] for x in raw)
    inner = ", ".join(raw)
    outer = ", ".join(out)
    return f"SELECT * EXCLUDE ({drop}), {outer} FROM (SELECT *, {inner} FROM ({source}))"


def stat_names(prefix: str = "", entropy: bool = True, windows=(5, 25, 50)) -> list[str]:
    return [f"{prefix}value_w{n}_{s}" for n in windows for s in (STATS if entropy else STATS[:4])]


def ratio_sql(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) IS NULL OR ({b}) = 0 THEN 1000 ELSE ({a}) / ({b}) END"


def own_mean_sql(c: str, part: str = "event_type") -> str:
    f = frame_sql(10, part)
    return ratio_sql(c, f"CASE WHEN count({c}) OVER {f} = 10 THEN avg({c}) OVER {f} END")
