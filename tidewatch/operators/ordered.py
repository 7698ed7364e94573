"""Global order without a global sort task: running sums, row index over all series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.series import BLOCK_ROWS, POS, SeriesSpec, join_keys, series_stats, with_ordered_cuts, with_positions


def running_sums(
    df: DataFrame, order: str, columns: Sequence[str], keys: Sequence[str] = (), block_rows: int | None = None
) -> DataFrame:
    """Add ``cum_{c}``: running sum of ``c`` by ascending ``order`` within the key group.

    ``order`` must be unique in its group (aggregate first).  Short groups use one window; longer
    ones are cut by value, summed per cut, and the cut totals are added back.
    """
    block_rows = block_rows or BLOCK_ROWS
    stats = series_stats(df, keys)
    up_to = (Window.unboundedPreceding, Window.currentRow)
    if stats.max_rows <= block_rows:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(*up_to)
        return df.select("*", *[F.sum(c).over(w).alias(f"cum_{c}") for c in columns])
    rows = with_ordered_cuts(df, list(keys), [order], stats, block_rows, "_cut")
    totals = rows.groupBy(*keys, "_cut").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    bw = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, "_cut", *[F.coalesce(F.sum(f"_t_{c}").over(bw), F.lit(0)).alias(f"_b_{c}") for c in columns])
    w = Window.partitionBy(*keys, "_cut").orderBy(order).rowsBetween(*up_to)
    rows = rows.select("*", *[F.sum(c).over(w).alias(f"_s_{c}") for c in columns])
    rows = join_keys(rows, carry, [*keys, "_cut"], "left")
    return rows.select(*df.columns, *[(F.col(f"_s_{c}") + F.col(f"_b_{c}")).alias(f"cum_{c}") for c in columns])


def with_global_index(
    df: DataFrame, spec: SeriesSpec, out: str = "idx", series_rank: str | None = None, **kw
) -> DataFrame:
    """0-based row index over the concatenation of all series (in key order, or by ``series_rank``).

    Rows keep their position in the series; each series adds the number of rows before it.
    """
    rows = with_positions(df, spec, **kw)
    sizes = df.groupBy(*spec.series).agg(
        F.count(F.lit(1)).alias("_n"), *([F.min(series_rank).alias("_rank")] if series_rank else [])
    )
    by = ["_rank", *spec.series] if series_rank else list(spec.series)
    offsets = prefix_counts(sizes, by, spec.series)
    rows = join_keys(rows, offsets, spec.series, "left")
    return rows.withColumn(out, F.col("_before") + F.col(POS)).drop("_before", POS)


SMALL_SERIES_TABLE = 1_000_000


def prefix_counts(sizes: DataFrame, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows before each series.  One row per series: a single window while there are few series,
    else two levels (by hashed range of the sorted keys written once)."""
    before = (Window.unboundedPreceding, -1)
    if sizes.count() <= SMALL_SERIES_TABLE:
        w = Window.partitionBy(F.lit(0)).orderBy(*by).rowsBetween(*before)
        return sizes.select(*keys, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    from tidewatch.series import durable

    parts = durable(
        sizes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    )
    totals = parts.groupBy("_part").agg(F.sum("_n").alias("_pn"))
    pw = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(*before)
    totals = totals.select("_part", F.coalesce(F.sum("_pn").over(pw), F.lit(0)).alias("_pb"))
    w = Window.partitionBy("_part").orderBy(*by).rowsBetween(*before)
    rows = parts.withColumn("_in", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return rows.join(F.broadcast(totals), "_part").select(*keys, (F.col("_pb") + F.col("_in")).alias("_before"))


def hash_rank(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed: int, out: str = "rank", **kw) -> DataFrame:
    """1-based rank by a seeded hash of the row ids within the key group: a reproducible shuffle.

    The order is uniform over the hash range, so a large group is cut evenly.
    """
    rows = df.withColumn("_hash", F.xxhash64(F.lit(seed), *ids))
    spec = SeriesSpec(tuple(keys), ("_hash", *ids), "")
    return with_positions(rows, spec, **kw).withColumn(out, F.col(POS) + 1).drop(POS, "_hash")
