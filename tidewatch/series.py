"""Series layout: who a row belongs to, how rows are ordered, and how a long series is cut.

Row-frame windows need every row of a frame in one task.  Partitioning by the series key alone
puts a whole series into one task, which fails when one series holds a large share of the data.
``over_series`` therefore looks at the row counts first (one column-pruned aggregate):

* no series is longer than ``block_rows``: ``PARTITION BY series`` as usual, one exchange;
* otherwise: every row gets its exact position in its series (``with_positions``), series are cut
  into blocks of ``block_rows`` positions, the last ``before`` / first ``after`` rows of a block are
  copied into the neighbouring block, the same window expressions run ``PARTITION BY series, block``
  and the copies are dropped.  Results are the same for any ``block_rows``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 1_000_000
BROADCAST_ROWS = 200_000

POS = "_pos"
TOTAL = "_total"
BLK = "_blk"


@dataclass(frozen=True)
class SeriesSpec:
    """Key columns, ordering columns and the measured column."""

    series: tuple[str, ...]
    order: tuple[str, ...]
    value: str = "value"

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.series).orderBy(*self.order)


@dataclass(frozen=True)
class SeriesStats:
    n_rows: int
    n_series: int
    max_rows: int


def series_stats(df: DataFrame, keys: Sequence[str]) -> SeriesStats:
    """Row count, series count and longest series; map-side combined, returns one row."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.sum("n").alias("r"), F.count(F.lit(1)).alias("s"), F.max("n").alias("m")).first()
    return SeriesStats(int(row.r or 0), int(row.s or 0), int(row.m or 0))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the files.

    The folder is the session's ``spark.checkpoint.dir``; it must be shared storage on a cluster.
    A temporary folder is used only when the setting is absent and the master is local (tests).
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the same folder and continue from the files.  Readers take only their
    columns, so this is the form for wide tables that several fits look at; ``durable`` keeps partitions."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    import tempfile

    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidewatch-"))
    return spark.conf.get("spark.checkpoint.dir")


def small(dim: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast hint only for a counted, bounded side; otherwise leave the join to AQE."""
    return F.broadcast(dim) if n_rows <= BROADCAST_ROWS else dim


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi join; the right side's key columns are dropped.

    Without a key the right side is the summary of the whole table: exactly one row.
    """
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def with_ordered_cuts(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], stats: SeriesStats, block_rows: int, out: str
) -> DataFrame:
    """Add ``out``: a cut number that ascends with ``order`` inside each key group.

    Rows are range-partitioned on the keys and the whole order key, about a block to a cut, and written
    once (reliable checkpoint), so that every later use sees the same cuts.  Cuts grow with the rows,
    rows with equal leading values spread over cuts, and any sortable type will do.  Only rows that
    are equal in the whole order key have to share a cut.
    """
    n_cuts = max(2, -(-stats.n_rows // block_rows))
    return durable(df.repartitionByRange(n_cuts, *keys, *order).withColumn(out, F.spark_partition_id()))


def with_positions(
    df: DataFrame, spec: SeriesSpec, block_rows: int | None = None, stats: SeriesStats | None = None
) -> DataFrame:
    """Add ``_pos``: exact 0-based position of the row in its series."""
    block_rows = block_rows or BLOCK_ROWS
    stats = stats or series_stats(df, spec.series)
    if stats.max_rows <= block_rows:
        w = spec.window() if spec.series else Window.partitionBy(F.lit(0)).orderBy(*spec.order)
        return df.withColumn(POS, F.row_number().over(w) - 1)
    keys = list(spec.series)
    cut = with_ordered_cuts(df, keys, spec.order, stats, block_rows, "_cut")
    counts = cut.groupBy(*keys, "_cut").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_cut", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*keys, "_cut").orderBy(*spec.order)
    ranked = cut.withColumn("_rn", F.row_number().over(w))
    placed = join_keys(ranked, offsets, [*keys, "_cut"], "left")
    return placed.withColumn(POS, F.col("_off") + F.col("_rn") - 1).drop("_off", "_rn", "_cut")


def with_totals(df: DataFrame, keys: Sequence[str], stats: SeriesStats, out: str = TOTAL) -> DataFrame:
    """Add the row count of each key group (aggregate first, then join back)."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return join_keys(df, small(totals, stats.n_series), keys, "left")


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hash-partition on the keys into the configured number of partitions.

    Series windows are bound by computation and widen rows many times, so the byte-based merging
    of small shuffle partitions (which applies to implicit exchanges) would leave cores idle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def over_series(
    df: DataFrame,
    spec: SeriesSpec,
    fn: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    totals: bool = False,
    keep_pos: bool = False,
    block_rows: int | None = None,
    stats: SeriesStats | None = None,
) -> DataFrame:
    """Run ``fn(df, window)`` so that frames reach ``before`` rows back and ``after`` rows ahead.

    ``fn`` may read ``_pos`` (0-based position) and, with ``totals``, ``_total`` (series length).
    """
    block_rows = block_rows or BLOCK_ROWS
    stats = stats or series_stats(df, spec.series)
    extra = [] if keep_pos else [POS]
    if totals:
        extra.append(TOTAL)
    if stats.max_rows <= block_rows:
        keys = list(spec.series) or [F.lit(0)]
        w = Window.partitionBy(*keys).orderBy(*spec.order)
        rows = spread(df, spec.series) if spec.series else df
        rows = rows.withColumn(POS, F.row_number().over(w) - 1)
        if totals:
            rows = rows.withColumn(TOTAL, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        return fn(rows, w).drop(*extra)
    size = max(block_rows, before, after, 1)
    rows = df
    if totals:
        rows = with_totals(rows, spec.series, stats)
    rows = with_positions(rows, spec, block_rows, stats)
    home = F.floor(F.col(POS) / size)
    offset = F.col(POS) % size
    copies = F.array(
        home,
        F.when(offset >= size - before, home + 1),
        F.when((offset < after) & (home > 0), home - 1),
    )
    rows = rows.withColumn(BLK, F.explode(F.array_compact(copies))).withColumn("_own", F.col(BLK) == home)
    w = Window.partitionBy(*spec.series, BLK).orderBy(POS)
    rows = spread(rows, [*spec.series, BLK])
    return fn(rows, w).where(F.col("_own")).drop(*extra, BLK, "_own")


def fill_forward(
    df: DataFrame,
    spec: SeriesSpec,
    columns: dict[str, Column],
    backward: bool = False,
    block_rows: int | None = None,
    stats: SeriesStats | None = None,
) -> DataFrame:
    """Add, per name, the nearest non-null value at or before the row (at or after if ``backward``).

    For long series the last non-null value of every earlier block is carried over through a table
    with one row per block.
    """
    block_rows = block_rows or BLOCK_ROWS
    stats = stats or series_stats(df, spec.series)

    def nearest(c: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
        # backward runs in descending order: a frame that only grows costs one step per row
        by = [F.desc(o) if backward else F.asc(o) for o in order]
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*by)
        return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    if stats.max_rows <= block_rows:
        return df.select("*", *[nearest(c, spec.series, spec.order).alias(n) for n, c in columns.items()])
    keys = list(spec.series)
    had_pos = POS in df.columns
    rows = df if had_pos else with_positions(df, spec, block_rows, stats)
    rows = rows.select("*", *[c.alias(f"_v_{n}") for n, c in columns.items()])
    rows = written(rows.withColumn("_fblk", F.floor(F.col(POS) / block_rows)))  # read twice; fills may follow each other
    pick = F.min_by if backward else F.max_by
    edge = rows.groupBy(*keys, "_fblk").agg(
        *[pick(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(POS))).alias(f"_e_{n}") for n in columns]
    )
    by = F.desc("_fblk") if backward else F.asc("_fblk")
    bw = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select(*keys, "_fblk", *[F.last(f"_e_{n}", ignorenulls=True).over(bw).alias(f"_k_{n}") for n in columns])
    out = rows.select("*", *[nearest(F.col(f"_v_{n}"), [*keys, "_fblk"], [POS]).alias(n) for n in columns])
    out = join_keys(out, carry, [*keys, "_fblk"], "left")
    for n in columns:
        out = out.withColumn(n, F.coalesce(n, f"_k_{n}"))
    drop = ["_fblk", *[f"_v_{n}" for n in columns], *[f"_k_{n}" for n in columns]]
    return out.drop(*drop, *([] if had_pos else [POS]))
