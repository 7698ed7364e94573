"""Parts shared by the operators: tables in the shared folder, components, text columns."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a side that may be broadcast, checked by a count before the join is built.
BROADCAST_ROWS = 20_000
SALTS = 32


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines see: ``spark.checkpoint.dir``; a folder of this machine only where
    the setting is missing and the whole session is one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-llm-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "llm") -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and go on from the files: the lineage is
    cut, later readers take only their columns, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str) -> Column:
    """The text, a missing one as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def kept_in_worker(name: str) -> dict:
    """A dictionary that lives as long as the Python process, across its tasks.  (Functions travel
    by value, so the globals of a module are new in every task.)"""
    return sys.modules.setdefault(f"tidewatch_worker_{name}", types.ModuleType(name)).__dict__


def over_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str | StructType) -> DataFrame:
    """``fn`` on every Arrow batch of every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def runs_of_text(lengths: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose lengths sum to ``most`` at most (a longer item stands alone)."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (a, b: long): rows (node, component), component the
    smallest node reachable.  Null ends and loops are ignored; nodes without a link have no row.

    Alternating large-star and small-star steps on (larger, smaller) edges.  Every step is a
    map-side combined minimum per node and a join back, so no neighbour list is ever gathered; the
    edges of each round are a written table.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(
        links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        check = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (check.n, check.h) == seen or not check.n:
            break
        seen = (check.n, check.h)
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionAll(roots)


def over_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table | None], schema: str, together: int = 24_000_000) -> DataFrame:
    """``fn(rows, starts)`` on tables of whole groups; ``starts`` has the first row of each group and
    the number of rows.  Many small groups come in one table of about ``together`` bytes.  ``keys``
    are integer columns without missing values."""

    def whole(parts: list[pa.Table], last: bool) -> tuple[pa.Table, np.ndarray, pa.Table | None]:
        rows = pa.concat_tables(parts).combine_chunks()
        change = np.zeros(rows.num_rows, dtype=bool)
        change[0] = True
        for k in keys:
            v = rows.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        if last:
            return rows, np.append(starts, rows.num_rows), None
        return rows.slice(0, starts[-1]), starts, rows.slice(starts[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                parts.append(pa.Table.from_batches([batch]))
                size += batch.nbytes
            if size >= together:
                rows, starts, rest = whole(parts, last=False)
                if rows.num_rows:
                    out = fn(rows, starts)
                    if out is not None:
                        yield from out.to_batches()
                    parts, size = [rest], rest.nbytes
                else:  # one group so far: ask again when it has doubled
                    parts, size = [rest], 0
        if parts:
            out = fn(*whole(parts, last=True)[:2])
            if out is not None:
                yield from out.to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def in_blocks(df: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """Deal large groups to pairs of blocks: columns ``left`` and ``right`` (block numbers, left <=
    right) and ``side`` (the row's own block).  Every two members meet in exactly one pair of blocks
    (those of one block where left = right); a group of at most ``most`` rows stays whole."""
    sizes = stored(df.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_n")).where("_n > 1"), "large")
    if sizes.count() <= BROADCAST_ROWS:  # large groups only: rows are dealt where they are, before any group meets
        dealt = df.join(F.broadcast(sizes), F.col(group) == F.col("_g"), "left")
    else:  # every group to SALTS tasks
        salted = sizes.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = df.withColumn("_s", F.pmod(F.xxhash64(member), F.lit(SALTS)).cast("int"))
        dealt = dealt.join(salted, (F.col(group) == F.col("_g")) & (F.col("_s") == F.col("_t")), "left").drop("_s", "_t")
    dealt = dealt.withColumn("_n", F.coalesce("_n", F.lit(1)))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64(F.lit("block"), member), F.col("_n")).cast("int"))
    other = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return other.withColumn("left", F.least("side", "_o")).withColumn("right", F.greatest("side", "_o")).drop("_g", "_n", "_o")
