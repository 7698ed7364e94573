"""Ranges, null positions, summaries and drift between two tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.quantiles import quantiles


def range_text(low: Column, high: Column) -> Column:
    return F.concat_ws("-", F.bround(low, 2).cast("string"), F.bround(high, 2).cast("string"))


def column_ranges(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key and column: low, high and the text "low-high" (2 decimals).

    Minimum and maximum are taken on the wide rows (one pass, no row multiplication), then turned.
    """
    wide = df.groupBy(*keys).agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"lo_{c}").alias("low"), F.col(f"hi_{c}").alias("high")) for c in columns])
    long = wide.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*")
    return long.withColumn("text", range_text(F.col("low"), F.col("high")))


def overall_ranges(ranges: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Roll-up over machines: one row per key with one "low-high" column per metric, from numbers."""
    m = F.col("metric")
    return ranges.groupBy(*keys).agg(
        *[range_text(F.min(F.when(m == c, F.col("low"))), F.max(F.when(m == c, F.col("high")))).alias(c) for c in columns]
    )


def group_counts(df: DataFrame, key: str, counted: str) -> DataFrame:
    """Count of non-null ``counted`` per key, largest first."""
    return df.groupBy(key).agg(F.count(counted).alias("count")).orderBy(F.desc("count"), key)


def top_keys(df: DataFrame, key: str, counted: str, n: int = 10) -> DataFrame:
    return group_counts(df, key, counted).limit(n)


def rows_of_top_keys(df: DataFrame, key: str, counted: str, n: int = 10) -> DataFrame:
    return df.join(F.broadcast(top_keys(df, key, counted, n).select(key)), key, "left_semi")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles (exact), max per column, one row per column.

    The columns become (column, value) pairs inside the scan and are aggregated map-side.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(F.explode(cells).alias("x")).select("x.column", "x.value")
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = quantiles(long, ["column"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return moments.join(quartiles, "column", "left")


def is_missing(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, rows with any missing value, names of columns with missing values, and whether that
    counts as found (more than one such row)."""
    columns = columns or df.columns
    any_missing = reduce(lambda a, b: a | b, [is_missing(df, c) for c in columns])
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_missing).alias("null_rows"),
        *[F.count_if(is_missing(df, c)).alias(f"_n_{c}") for c in columns],
    )
    names = F.array_compact(F.array(*[F.when(F.col(f"_n_{c}") > 0, F.lit(c)) for c in columns]))
    return row.select("rows", "null_rows", F.array_join(F.array_sort(names), ",").alias("null_columns"), (F.col("null_rows") > 1).alias("found"))


def null_positions(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """(row, column) of every missing value."""
    hits = F.array_compact(F.array(*[F.when(is_missing(df, c), F.lit(c)) for c in columns]))
    return df.select(row_id, F.explode(hits).alias("column"))


def new_values(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Distinct test values that never occur in train."""
    return test.select(column).distinct().join(train.select(column).distinct(), column, "left_anti")


def drift_report(train: DataFrame, test: DataFrame, columns: Sequence[str], max_distinct: int = 10) -> DataFrame:
    """Per column: value ranges for numeric columns with more than ``max_distinct`` train values,
    else the test values unseen in train.

    Ranges of all columns come from one pass over each table.
    """
    numeric = [f.name for f in train.schema.fields if f.name in columns and isinstance(f.dataType, T.NumericType)]
    # collect_set would keep every value; the sketch answers all clear cases in the same pass
    sketch = [F.approx_count_distinct(c, 0.01).alias(f"d_{c}") for c in numeric]

    def ranges(side: str) -> list[Column]:
        return [f(c).cast("double").alias(f"{side}_{n}_{c}") for c in numeric for n, f in (("min", F.min), ("max", F.max))]

    a, b = train.agg(F.count(F.lit(1)).alias("n"), *ranges("train"), *sketch).first(), test.agg(F.count(F.lit(1)).alias("n"), *ranges("test")).first()

    def many(c: str) -> bool:
        if abs(a[f"d_{c}"] - max_distinct) > 2 + max_distinct // 5:
            return a[f"d_{c}"] > max_distinct
        return train.select(c).distinct().limit(max_distinct + 1).count() > max_distinct

    wide = [c for c in numeric if many(c)]
    rows = [(c, a[f"train_min_{c}"], a[f"train_max_{c}"], b[f"test_min_{c}"], b[f"test_max_{c}"], None) for c in wide]
    schema = "`column` string, train_min double, train_max double, test_min double, test_max double, new_value string"
    out = [train.sparkSession.createDataFrame(rows, schema)]
    none = F.lit(None).cast("double")
    for c in columns:
        if c not in wide:
            out.append(
                new_values(train, test, c).select(
                    F.lit(c).alias("column"), *[none.alias(f"{t}_{m}") for t in ("train", "test") for m in ("min", "max")],
                    F.col(c).cast("string").alias("new_value"),
                )
            )
    return reduce(DataFrame.unionByName, out)


def feature_pairs(df: DataFrame, row_id: str, label: str, features: Sequence[str]) -> DataFrame:
    """Every unordered feature pair as points (row, x_name, y_name, x, y, label): plot data."""
    pairs = [
        F.struct(F.lit(a).alias("x_name"), F.lit(b).alias("y_name"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
        for i, a in enumerate(features)
        for b in features[i + 1 :]
    ]
    return df.select(row_id, label, F.explode(F.array(*pairs)).alias("p")).select(row_id, label, "p.*")
