"""Near-duplicate vectors by sorted projection passes.

Every pass gives each vector a key of concatenated random hashes: the place and the sign of the
largest coordinate of a random projection, several times.  Vectors are ordered by the key across the
cluster, and each is compared with the ``WINDOW`` vectors behind it, in double precision.  Runs with
the same leading hashes that are longer than a window and not yet one component are compared whole, in
blocks, so a pair whose leading hashes agree in some pass is found however dense the vectors lie.  The
number of leading hashes follows from the number of vectors, the number of passes from both.  Verified
pairs of all passes are joined to components.  Equal vectors are one node, so copies do not fill the
windows.  Links beyond the windows are counted exactly: inside each component, in blocks of bounded
size, all members are compared and only the number of links per vector leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import components, in_blocks, over_batches, over_groups, stored
from tidewatch.llm.minhash import spanning

#: Least number of passes; ``passes_for`` asks for more where there are many vectors.
PASSES = 16
WINDOW = 24
#: One hash agrees for a pair of cosine 0.9 with this probability (measured: 0.49 to 0.50 in 8, 64 and 384 dimensions).
AGREE = 0.49
#: Pairs of cosine 0.9 that may be missed by all passes.
MISS = 0.01
#: Coordinates of one random projection: 2 * PLACES values per hash.
PLACES = 32
#: Vectors of a component that meet in one task.
BLOCK = 2_000


def units(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def leading_hashes(n: int, window: int) -> int:
    """Hashes that cut ``n`` spread vectors to runs of about a window."""
    k = 0
    while window * (2 * PLACES) ** k < n and k < 10:
        k += 1
    return k


def passes_for(n: int, window: int) -> int:
    """Passes of which at most ``MISS`` of the pairs of cosine 0.9 share the leading hashes in none."""
    q = AGREE ** leading_hashes(n, window)
    return PASSES if q >= 1 else max(PASSES, math.ceil(math.log(MISS) / math.log1p(-q)))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, raw): the components as bytes of doubles; missing for a vector that links with nothing."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw: list[bytes | None] = []
        for v in batch.column("v").to_pylist():
            x = np.array(v if v is not None else [], dtype=np.float64)  # a missing component is NaN
            fine = len(x) and np.isfinite(x).all() and x.any() and np.isfinite(np.linalg.norm(x)) and np.linalg.norm(x) > 0
            raw.append((x + 0.0).tobytes() if fine else None)
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary())], ["id", "raw"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return over_batches(rows, run, "id long, raw binary")


def keyed(nodes: DataFrame, passes: int, hashes: int, seed: int) -> DataFrame:
    """(pass, size, key, rep, raw): a row per node and pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw").to_pylist()
            size = np.array([len(r) // 8 for r in raw])
            for d in np.unique(size):
                mine = np.flatnonzero(size == d)
                for a in range(0, len(mine), 2_000):
                    part = mine[a : a + 2_000]
                    rows = batch.take(pa.array(part))
                    x = units([raw[i] for i in part])
                    for p in range(passes):
                        rng = np.random.default_rng([seed, p, int(d)])
                        key = np.zeros(len(part), dtype=np.int64)
                        for _ in range(hashes):
                            y = x @ rng.standard_normal((int(d), PLACES))
                            place = np.abs(y).argmax(axis=1)
                            key = key * (2 * PLACES) + 2 * place + (y[np.arange(len(y)), place] < 0)
                        n = len(part)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, d, np.int32)), pa.array(key), rows.column("rep"), rows.column("raw")], ["pass", "size", "key", "rep", "raw"])

    return nodes.select("rep", "raw").mapInArrow(run, "pass int, size int, key long, rep long, raw binary")


def window_links(rows: pa.Table, window: int, least: float, older: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs at most ``window`` rows apart, of one pass and size, with the cosine reached.
    The first ``older`` rows were compared with each other before."""
    size, passes = rows.column("size").to_numpy(), rows.column("pass").to_numpy()
    raw = rows.column("raw").to_pylist()
    x = np.zeros((len(raw), int(size.max())))
    for d in np.unique(size):
        mine = np.flatnonzero(size == d)
        x[mine, : int(d)] = units([raw[i] for i in mine])
    first, second = [], []
    for step in range(1, min(window, len(raw) - 1) + 1):
        hit = (np.einsum("ij,ij->i", x[:-step], x[step:]) >= least) & (size[:-step] == size[step:]) & (passes[:-step] == passes[step:])
        i = np.flatnonzero(hit)
        i = i[i + step >= older]
        first.append(i)
        second.append(i + step)
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def pass_links(sorted_rows: DataFrame, window: int, least: float) -> DataFrame:
    """Links (a, b) of neighbours in sorted partitions, and across their borders."""
    schema = "part int, head boolean, pass int, size int, rep long, raw binary, a long, b long"

    def found(rows: pa.Table, older: int = 0) -> pa.RecordBatch | None:
        x, y = window_links(rows, window, least, older)
        rep = rows.column("rep").to_numpy()
        keep = spanning(x, y, rep)
        if not keep:
            return None
        n = len(keep)
        a, b = rep[x[keep]], rep[y[keep]]
        none = [pa.nulls(n, t) for t in (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*none, pa.array(a), pa.array(b)], ["part", "head", "pass", "size", "rep", "raw", "a", "b"])

    def edge(rows: pa.Table, head: bool) -> pa.RecordBatch:
        n = rows.num_rows
        columns = [rows.column(c).combine_chunks() for c in ("pass", "size", "rep", "raw")]
        part = pa.array(np.full(n, TaskContext.get().partitionId(), np.int32))
        return pa.RecordBatch.from_arrays([part, pa.array([head] * n), *columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], ["part", "head", "pass", "size", "rep", "raw", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for a in range(0, batch.num_rows, 4_000):
                rows = pa.Table.from_batches([batch.slice(a, 4_000)]).select(["pass", "size", "rep", "raw"])
                if last is None:
                    yield edge(rows.slice(0, window), True)
                older = 0 if last is None else last.num_rows
                rows = rows if last is None else pa.concat_tables([last, rows]).combine_chunks()
                if (out := found(rows, older)) is not None:
                    yield out
                last = rows.slice(max(0, rows.num_rows - window))
        if last is not None:
            yield edge(last, False)

    out = stored(sorted_rows.mapInArrow(run, schema), "passes")
    inner = out.where("a IS NOT NULL").select("a", "b")
    # borders: the last rows of a partition and the first of the next that has any
    parts = sorted(r.part for r in out.where("part IS NOT NULL").select("part").distinct().collect())  # as many as tasks
    if len(parts) < 2:
        return inner
    spark = out.sparkSession
    place = spark.createDataFrame([(p, i) for i, p in enumerate(parts)], "part int, i int")
    edges = out.where("part IS NOT NULL").join(F.broadcast(place), "part").select((F.col("i") - F.col("head").cast("int")).alias("border"), (~F.col("head")).cast("int").alias("side"), "pass", "size", "rep", "raw")

    def across(t: pa.Table, starts: np.ndarray) -> pa.Table | None:
        a, b = [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            rows = t.slice(lo, hi - lo)
            if rows.num_rows < 2:
                continue
            x, y = window_links(rows.select(["pass", "size", "rep", "raw"]), 2 * window, least)
            rep = rows.column("rep").to_numpy()
            for i in spanning(x, y, rep):
                a.append(int(rep[x[i]]))
                b.append(int(rep[y[i]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}) if a else None

    return inner.unionAll(over_groups(edges, ["border"], across, "a long, b long"))


def run_links(nodes: DataFrame, found: DataFrame, prefixes: DataFrame, window: int, least: float, block: int) -> DataFrame | None:
    """Links (a, b) between the components that meet in runs longer than a window; none if there are
    no such runs.  ``prefixes``: (pass, size, key, rep), the key of the leading hashes only."""
    long_runs = prefixes.groupBy("pass", "size", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > window + 1).drop("n")
    rows = prefixes.join(long_runs, ["pass", "size", "key"]).join(found.withColumnRenamed("node", "rep"), "rep", "left")
    rows = stored(rows.select(F.xxhash64("pass", "size", "key").alias("run"), "size", "rep", F.coalesce("component", "rep").alias("component")), "runs")
    apart = rows.groupBy("run").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("run")
    open_rows = rows.join(apart, "run", "left_semi")
    if open_rows.isEmpty():
        return None

    def compare(t: pa.Table, starts: np.ndarray) -> pa.Table | None:
        first, second = [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            rows = t.slice(lo, hi - lo)
            x = units(rows.column("raw").to_pylist())
            side, component = (rows.column(c).to_numpy() for c in ("side", "component"))
            crossed = rows.column("left")[0].as_py() != rows.column("right")[0].as_py()
            for a in range(0, len(x), 500):
                part = slice(a, a + 500)
                hit = (x[part] @ x.T >= least) & (component[part][:, None] < component[None, :])
                if crossed:
                    hit &= side[part][:, None] != side[None, :]
                i, j = np.nonzero(hit)
                first.append(component[part][i])
                second.append(component[j])
        a, b = np.concatenate(first), np.concatenate(second)
        keep = spanning(np.arange(len(a)), np.arange(len(a)) + len(a), np.concatenate([a, b]))
        return pa.table({"a": a[keep], "b": b[keep]}) if keep else None

    blocks = in_blocks(open_rows.join(nodes.select("rep", "raw"), "rep"), "run", "rep", block)
    keys = ["size", "run", "left", "right"]
    return over_groups(blocks.select(*keys, "side", "component", "raw"), keys, compare, "a long, b long")


def link_counts(members: DataFrame, least: float, block: int) -> DataFrame:
    """(rep, links): copies of the other nodes of its component that a node is linked with."""

    def count(t: pa.Table, starts: np.ndarray) -> pa.Table | None:
        reps, sums = [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            rows = t.slice(lo, hi - lo)
            x = units(rows.column("raw").to_pylist())
            copies, side, rep = (rows.column(c).to_numpy() for c in ("copies", "side", "rep"))
            crossed = rows.column("left")[0].as_py() != rows.column("right")[0].as_py()
            total = np.zeros(len(rep), dtype=np.int64)
            for a in range(0, len(rep), 500):
                part = slice(a, min(len(rep), a + 500))
                hit = x[part] @ x.T >= least
                if crossed:
                    hit &= side[part][:, None] != side[None, :]
                hit[np.arange(part.stop - part.start), np.arange(part.start, part.stop)] = False
                total[part] += hit @ copies
            reps.append(rep)
            sums.append(total)
        return pa.table({"rep": np.concatenate(reps), "links": np.concatenate(sums)})

    keys = ["component", "left", "right"]
    blocks = in_blocks(members, "component", "rep", block)
    return over_groups(blocks.select(*keys, "side", "rep", "copies", "raw"), keys, count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_vectors(
    vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding",
    passes: int | None = None, window: int = WINDOW, seed: int = 11, block: int = BLOCK,
) -> DataFrame:
    """One row per row of ``vectors``: the id (as long), n_links, component_id and kept.

    Vectors of equal length are linked if their cosine is at least ``least``.  A vector that is
    missing, zero, empty, or holds missing or non-finite numbers is linked with nothing.  Repeated
    vectors are linked with each other; a row without an id is linked with nothing and has no
    component.  Other columns are ignored.  Without ``passes`` their number follows from that of the
    different vectors (``passes_for``).
    """
    rows = stored(usable(vectors, id_col, vector_col).withColumn("digest", F.md5("raw")), "vectors")
    nodes = stored(rows.where("raw IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw")), "nodes")
    n = nodes.count()
    hashes = 1
    while (2 * PLACES) ** (hashes - 1) < max(n, 1) and hashes < 10:
        hashes += 1
    passes = passes or passes_for(n, window)
    order = ["pass", "size", "key", F.xxhash64("pass", "rep"), "rep"]
    ordered = keyed(nodes, passes, hashes, seed).repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(components(pass_links(ordered, window, least)), "vector_components")
    prefixes = keyed(nodes, passes, leading_hashes(n, window), seed).select("pass", "size", "key", "rep")
    if (more := run_links(nodes, found, stored(prefixes, "prefixes"), window, least, block)) is not None:
        found = stored(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)), "vector_components")
    members = nodes.select("rep", "copies", "raw").join(found.withColumnRenamed("node", "rep"), "rep")
    counts = link_counts(members, least, block)
    labels = nodes.select(F.col("digest").alias("_digest"), "rep", "copies").join(found.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    labels = labels.select("_digest", F.coalesce("component", "rep").alias("_component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"))
    joined = rows.select("id", "digest").join(labels, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("_component", "id"))
    return joined.select(F.col("id").alias(id_col), F.when(F.col("id").isNotNull(), F.coalesce("_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )
