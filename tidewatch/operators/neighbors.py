"""Exact k nearest neighbours by pivot cells.

Every train row belongs to its nearest pivot.  From the distances of a query to the pivots, the
k smallest cell radii give an upper bound on its k-th distance, and the triangle inequality rules
out cells (and train rows) that cannot hold a neighbour.  Queries go only to the cells left.
Small cells are packed into groups of about a block, and groups cut into blocks on both sides, so a task compares two bounded blocks and keeps k rows
per query; the partial results are merged per query.  Every query travels to every block of the cells left, so
blocks of large tables are larger (``block_rows``) and vectors travel in the digits they came with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.series import written

MAX_PIVOTS = 4_096
BLOCK = 5_000
#: What the vectors of a block of a large table may take (8 bytes a number), and how many blocks a side of it has at least.
BLOCK_BYTES = 50_000_000
SIDE_BLOCKS = 4
#: From this share of (query, group) pairs on, groups spare so little that they are joined up to whole blocks.
DENSE_SHARE = 0.5
#: Numbers held at once when a block is compared.
COMPARED_NUMBERS = 4_000_000
#: Columns whose least value stands for them in the bound of the nearest ones.
STRIP = 64
#: Numbers held at once when the bounds of a batch of queries are taken.
BOUND_NUMBERS = 8_000_000
#: Distances to pivots held at once.
SLICE_NUMBERS = 2_000_000


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances between all rows of two small blocks, one dimension at a time."""
    out = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d = x[:, j, None] - y[None, :, j]
        out += d * d
    return np.sqrt(out)


def _close_pairs(x: np.ndarray, y: np.ndarray, m: int, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, distance) of pairs that hold the ``m`` nearest rows of y of every row of x, and
    all ties of the last one.  A product of matrices rules pairs out, with more room than it can be
    wrong by; what is left is measured as ``_distances`` does."""
    a, b = (x * x).sum(axis=1), (y * y).sum(axis=1)
    if np.isfinite(a).all() and np.isfinite(b).all():
        near = (-2.0 * x) @ y.T
        near += a[:, None]
        near += b
        room = 8e-16 * (x.shape[1] + 16) * (a + b.max())
        strips = len(y) // STRIP
    else:
        near, room, strips = _distances(x, y), np.zeros(len(x)), 0
    if skip is not None:
        near[skip] = np.inf
    # the m-th least of the strips' least values is no less than the m-th of all
    few = near[:, : strips * STRIP].reshape(len(x), strips, STRIP).min(axis=2) if strips >= 4 * m else near
    limit = np.partition(few, m - 1, axis=1)[:, m - 1] + 2 * room
    qi, ti = np.nonzero(near <= limit[:, None])
    total = np.zeros(len(qi))
    for j in range(x.shape[1]):
        d = x[qi, j] - y[ti, j]
        total += d * d
    dist = np.sqrt(total)
    if skip is not None:
        dist[skip[qi, ti]] = np.inf
    return qi, ti, dist


def _packed(centre: np.ndarray, rows: np.ndarray, block: int) -> np.ndarray:
    """The group of every cell: small cells next to each other along the widest direction of the pivots,
    about a block of rows together, so that a query travels once to a group and not once to each of its cells."""
    place = np.zeros(len(centre))
    if len(centre) > 1 and np.isfinite(centre).all():
        off = centre - centre.mean(axis=0)
        place = off @ np.linalg.eigh(off.T @ off)[1][:, -1]
    group, out, filled = -1, np.zeros(len(centre), dtype=int), block
    for c in np.argsort(place, kind="stable"):
        if filled + rows[c] > block:
            group, filled = group + 1, 0
        out[c], filled = group, filled + rows[c]
    return out


def block_rows(rows: int, dimensions: int, cores: int) -> int:
    """Rows of a block: copies of a row grow with the blocks, so large tables take as few as memory and even work allow."""
    sides = max(SIDE_BLOCKS, int(np.ceil((6 * cores) ** 0.5)))
    return max(BLOCK, min(BLOCK_BYTES // (8 * max(1, dimensions)), -(-rows // sides)))


def _joined(sizes: np.ndarray, block: int) -> np.ndarray:
    """The larger group of every group: neighbouring ones with about a block of rows together."""
    out, filled, at = np.zeros(len(sizes), dtype=int), 0, 0
    for g, n in enumerate(sizes):
        if filled and filled + n > block:
            at, filled = at + 1, 0
        out[g], filled = at, filled + n
    return out


def _vector(name: str, df: DataFrame) -> Column:
    """Single digits stay single on their way; tasks compute in double."""
    kept = df.select(name).schema[0].dataType.simpleString() in ("array<float>", "array<double>")
    return F.col(name) if kept else F.col(name).cast("array<double>")


def nearest(
    queries: DataFrame, train: DataFrame, query_id: str, train_id: str, query_vector: str, train_vector: str,
    k: int = 5, exclude_same: bool = False, pivots: int | None = None, block: int | None = None,
) -> DataFrame:
    """Rows (query_id, train_id, distance, rank): the k nearest train rows, ties by train id.

    ``exclude_same`` skips a train row whose id equals the query id (search inside one table).
    """
    q = queries.select(F.col(query_id).alias("qid"), _vector(query_vector, queries).alias("qv"))
    t = train.select(F.col(train_id).alias("tid"), _vector(train_vector, train).alias("tv"))
    qid_type, tid_type = q.schema["qid"].dataType.simpleString(), t.schema["tid"].dataType.simpleString()
    need = k + 1 if exclude_same else k
    n_train = t.count()
    n_pivots = pivots or int(min(MAX_PIVOTS, max(1, n_train**0.5)))  # balances pivots against rows per cell
    chosen = t.orderBy(F.xxhash64("tid"), "tid").limit(n_pivots).select("tv").collect()
    centre = np.array([r["tv"] for r in chosen], dtype=float)
    packed_rows = block or BLOCK
    block = block or block_rows(n_train, centre.shape[-1], queries.sparkSession.sparkContext.defaultParallelism)

    slice_rows = max(1, SLICE_NUMBERS // max(1, len(centre)))

    def slices(v: pd.Series) -> Iterator[np.ndarray]:
        for a in range(0, len(v), slice_rows):
            yield np.stack(v.iloc[a : a + slice_rows].to_numpy()).astype(float)

    def assign(batches):
        for (v,) in batches:
            cell, r = [np.zeros(0, "int32")], [np.zeros(0)]
            for x in slices(v):
                d = _distances(x, centre)
                cell.append(d.argmin(axis=1).astype("int32"))
                r.append(d[np.arange(len(d)), cell[-1]])
            yield pd.DataFrame({"cell": np.concatenate(cell), "r": np.concatenate(r)})

    assign_udf = _iter_udf(assign, "cell int, r double")
    placed = written(t.withColumn("_a", assign_udf("tv")).select("tid", "tv", "_a.cell", "_a.r"))  # read three times
    w = Window.partitionBy("cell").orderBy("r")
    closest = placed.select("cell", "r").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= need).collect()
    sizes = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("far")).collect()}
    far = np.array([sizes[c]["far"] if c in sizes else -np.inf for c in range(len(centre))])
    near_cell = np.array([r["cell"] for r in closest], dtype=int)
    near_r = np.array([r["r"] for r in closest], dtype=float)

    def limits(d: np.ndarray) -> np.ndarray:
        """Upper bound of the distance to the ``need``-th neighbour of each query."""
        if len(near_cell) < need:
            return np.full(len(d), np.inf)
        step = max(1, BOUND_NUMBERS // len(near_cell))
        parts = [np.partition(d[a : a + step][:, near_cell] + near_r[None, :], need - 1, axis=1)[:, need - 1] for a in range(0, len(d), step)]
        return np.concatenate(parts)

    in_cell = np.array([sizes[c]["n"] if c in sizes else 0 for c in range(len(centre))])
    group_of = _packed(centre, in_cell, packed_rows)

    def reach(batches):
        for (v,) in batches:
            cells = []
            for x in slices(v):
                d = _distances(x, centre)
                limit = limits(d) * (1 + 1e-12) + 1e-12
                hit = d - far[None, :] <= limit[:, None]
                cells += [np.unique(group_of[h]).tolist() for h in hit]
            yield pd.DataFrame({"cells": cells})

    reach_udf = _iter_udf(reach, "cells array<int>")
    reached = written(q.withColumn("_r", reach_udf("qv")).select("qid", "qv", "_r.cells"))  # read twice; a vector is stored once
    asked_sizes = {r["cell"]: r["n"] for r in reached.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = int(group_of.max()) + 1 if len(group_of) else 0
    if sum(asked_sizes.values()) > DENSE_SHARE * groups * max(asked_sizes.values(), default=0):
        larger = _joined(np.bincount(group_of, in_cell, groups), block)
        group_of, groups = larger[group_of], int(larger.max()) + 1
        reached = reached.withColumn("cells", F.array_distinct(F.transform("cells", lambda c: F.get(F.array(*[F.lit(int(g)) for g in larger]), c))))
        asked_sizes = {r["cell"]: r["n"] for r in reached.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    asked = reached.withColumn("cell", F.explode("cells")).drop("cells")

    def blocks_of(counts: dict[int, int]) -> Column:  # blocks per cell, from at most MAX_PIVOTS counts
        values = [F.lit(max(1, -(-counts.get(c, 1) // block))).cast("long") for c in range(groups)]
        return F.get(F.array(*values), F.col("cell"))

    t_blocks = blocks_of({g: int(in_cell[group_of == g].sum()) for g in range(groups)})
    q_blocks = blocks_of(asked_sizes)
    left = asked.withColumn("qb", F.pmod(F.xxhash64("qid"), q_blocks)).withColumn(
        "tb", F.explode(F.sequence(F.lit(0).cast("long"), t_blocks - 1))
    )
    grouped = placed.withColumn("cell", F.get(F.array(*[F.lit(int(g)) for g in group_of]), F.col("cell")))
    right = grouped.withColumn("tb", F.pmod(F.xxhash64("tid"), t_blocks)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), q_blocks - 1))
    )

    def compare(lhs: pd.DataFrame, rhs: pd.DataFrame) -> pd.DataFrame:
        if not len(lhs) or not len(rhs):
            return pd.DataFrame({"qid": [], "tid": [], "distance": []})
        rhs = rhs.sort_values("tid", kind="stable")
        tv, tid = np.stack(rhs["tv"].to_numpy()).astype(float), rhs["tid"].to_numpy()
        m, ids, out = min(k, len(tv)), lhs["qid"].to_numpy(), []
        step = max(1, min(256, COMPARED_NUMBERS // len(tv)))
        for i in range(0, len(lhs), step):
            own = ids[i : i + step]
            skip = own[:, None] == tid[None, :] if exclude_same else None
            qi, ti, dist = _close_pairs(np.stack(lhs["qv"].iloc[i : i + step].to_numpy()).astype(float), tv, m, skip)
            order = np.lexsort((ti, dist, qi))
            qi, ti, dist = qi[order], ti[order], dist[order]
            keep = (np.arange(len(qi)) - np.searchsorted(qi, qi) < m) & np.isfinite(dist)
            out.append((own[qi[keep]], tid[ti[keep]], dist[keep]))
        qid, near, distance = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"qid": qid, "tid": near, "distance": distance})

    key = ["cell", "tb", "qb"]
    # pairs of blocks are few and long, so they are not put together by their bytes
    pairs = sum(max(1, -(-asked_sizes.get(g, 1) // block)) * max(1, -(-int(in_cell[group_of == g].sum()) // block)) for g in range(groups))
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4 * pairs, 10_000))
    left, right = left.repartition(tasks, *key), right.repartition(tasks, *key)
    local = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        compare, f"qid {qid_type}, tid {tid_type}, distance double"
    )
    by_query = Window.partitionBy("qid").orderBy("distance", "tid")
    best = local.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return best.select(F.col("qid").alias(query_id), F.col("tid").alias(f"near_{train_id}"), "distance", "rank")


def _iter_udf(fn, schema: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return fn((b,) for b in batches)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema)


def knn_classify(
    queries: DataFrame, train: DataFrame, query_id: str, train_id: str, vector: str, label: str, k: int = 5, **kw
) -> DataFrame:
    """Majority label of the k nearest train rows (the smaller label wins a tie)."""
    found = nearest(queries, train, query_id, train_id, vector, vector, k, **kw)
    votes = found.join(train.select(F.col(train_id).alias(f"near_{train_id}"), F.col(label).alias("_label")), f"near_{train_id}")
    counts = votes.groupBy(query_id, "_label").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(query_id).agg(F.max_by("_label", F.struct("_n", -F.col("_label"))).alias("predicted"))
