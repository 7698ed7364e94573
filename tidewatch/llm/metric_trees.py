"""Vector codes by k-means over the parts of a vector, on anchors-hierarchy metric trees.

Every block of vectors gets one tree per part, built middle-out: about sqrt(n) anchors are placed, each
the point farthest from its own anchor, and take over the points that are nearer to them; anchors are
merged upwards, the pair with the smallest common ball first, and every anchor's points are divided
downwards in the same way.  A ball caches the number and the sum of its points.

In a round a ball inherits the candidate entries of its parent and loses those that lie, seen from its
centre, behind the bisector with the nearest entry by more than its radius.  With one candidate
left it is wholly owned and adds its cached sum and count; leaves with several compare their
points exactly.  Trees are built once and stored, rounds only read them; what leaves a task is a sum and
a count per entry.  All results are exact integers: pruning keeps a margin for rounding, so that
ties are always decided by comparison (lowest entry).
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BROADCAST_ROWS, stored
from tidewatch.llm.integers import integer_vectors, matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Points of a ball that is not divided.
LEAF = 24
#: Vectors of a block, and numbers at most.
BLOCK, BLOCK_NUMBERS = 8_192, 2_000_000
SALTS = 32


def cuts(size: int, parts: int) -> list[slice]:
    """Consecutive parts, as equal as can be (the first ones take what is left over)."""
    ends = np.cumsum([0] + [size // parts + (i < size % parts) for i in range(parts)])
    return [slice(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]


# ---- trees ----------------------------------------------------------------------------------------


def anchors(x: np.ndarray, most: int) -> np.ndarray:
    """The anchor number of every point."""
    owner = np.zeros(len(x), dtype=np.int64)
    places = [x[0]]
    far = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(places) < most:
        new = int(far.argmax())
        if far[new] == 0:
            break
        gap = np.sqrt(((np.array(places) - x[new]) ** 2).sum(axis=1))
        near = np.flatnonzero(far >= gap[owner] / 2)  # nearer points can't change their anchor
        d = np.sqrt(((x[near] - x[new]) ** 2).sum(axis=1))
        won = d < far[near]
        owner[near[won]] = len(places)
        far[near[won]] = d[won]
        places.append(x[new])
    return owner


def merged(x: np.ndarray, groups: list[np.ndarray]) -> list[tuple[int, int]]:
    """The order in which groups are merged to one: numbers of the two, new groups counted on."""
    k = len(groups)
    centre, radius, count = np.zeros((2 * k - 1, x.shape[1])), np.zeros(2 * k - 1), np.zeros(2 * k - 1)
    cost = np.full((2 * k - 1, 2 * k - 1), np.inf)
    live: list[int] = []
    steps: list[tuple[int, int]] = []

    def add(i: int) -> None:
        if live:
            o = np.array(live)
            n = count[i] + count[o]
            both = (centre[i] * count[i] + centre[o] * count[o][:, None]) / n[:, None]
            reach = np.maximum(np.sqrt(((both - centre[i]) ** 2).sum(axis=1)) + radius[i], np.sqrt(((both - centre[o]) ** 2).sum(axis=1)) + radius[o])
            cost[i, o] = reach
        live.append(i)

    for i, g in enumerate(groups):
        centre[i], count[i] = x[g].mean(axis=0), len(g)
        radius[i] = np.sqrt(((x[g] - centre[i]) ** 2).sum(axis=1).max())
        add(i)
    for new in range(k, 2 * k - 1):
        i, j = divmod(int(cost.argmin()), 2 * k - 1)
        steps.append((i, j))
        radius[new], count[new] = cost[i, j], count[i] + count[j]
        centre[new] = (centre[i] * count[i] + centre[j] * count[j]) / count[new]
        cost[[i, j], :] = np.inf
        cost[:, [i, j]] = np.inf
        live.remove(i)
        live.remove(j)
        add(new)
    return steps


def divided(x: np.ndarray, points: np.ndarray, leaf: int) -> tuple | np.ndarray:
    """Nested pairs down to arrays of points."""
    if len(points) <= leaf:
        return points
    owner = anchors(x[points], max(2, int(np.sqrt(len(points)))))
    groups = [points[owner == a] for a in range(int(owner.max()) + 1)]
    groups = [g for g in groups if len(g)]
    if len(groups) == 1:  # equal points
        return points
    nodes: list[tuple | np.ndarray] = [divided(x, g, leaf) for g in groups]
    for i, j in merged(x, groups):
        nodes.append((nodes[i], nodes[j]))
    return nodes[-1]


def tree_of(x: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Arrays of the balls: centre, radius, sum, first and last point (in ``order``), children (-1: leaf).
    A ball stands before its children."""
    whole = x.astype(np.float64)
    order: list[np.ndarray] = []
    lo, hi, left, right = [], [], [], []
    placed = 0
    todo: list[tuple] = [(divided(whole, np.arange(len(x)), leaf), -1, 0)]
    while todo:  # depth first, so that a ball's points lie together
        item, parent, side = todo.pop()
        if parent == -2:  # all below this ball is placed
            hi[side] = placed
            continue
        i = len(lo)
        if parent >= 0:
            (left, right)[side][parent] = i
        lo.append(placed)
        hi.append(placed)
        left.append(-1)
        right.append(-1)
        if isinstance(item, tuple):
            todo += [(None, -2, i), (item[1], i, 1), (item[0], i, 0)]
        else:
            order.append(item)
            placed += len(item)
            hi[i] = placed
    o = np.concatenate(order)
    sums, centre, radius = np.zeros((len(lo), x.shape[1]), np.int64), np.zeros((len(lo), x.shape[1])), np.zeros(len(lo))
    for i, (a, b) in enumerate(zip(lo, hi, strict=True)):
        mine = x[o[a:b]]
        sums[i] = mine.sum(axis=0)
        centre[i] = sums[i] / (b - a)
        radius[i] = np.sqrt(((mine - centre[i]) ** 2).sum(axis=1).max())
    return {"order": o, "lo": np.array(lo), "hi": np.array(hi), "left": np.array(left), "right": np.array(right), "sum": sums, "centre": centre, "radius": radius}


# ---- a round over one tree --------------------------------------------------------------------------


def exact_squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, exact: in doubles where they suffice, else in 64 bits."""
    bound = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * bound * bound * max(1, x.shape[1]) < 2**52 else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]


def owned(tree: dict[str, np.ndarray], x: np.ndarray, entries: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, int]:
    """Wholly owned balls with their entries; points of the other leaves with theirs; comparisons made."""
    c = entries.astype(np.float64)
    cc = (c * c).sum(axis=1)
    apart = np.sqrt(np.maximum(exact_squares(entries, entries).astype(np.float64), 0))
    candidates = ~(np.tril(apart == 0, -1)).any(axis=1)  # of equal entries the first owns all
    balls: list[tuple[np.ndarray, np.ndarray]] = []
    points, winners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    level, lists, compared = np.zeros(1, np.int64), candidates[None, :], 0
    while len(level):
        m, r = tree["centre"][level], tree["radius"][level]
        mm = (m * m).sum(axis=1)
        d = np.where(lists, mm[:, None] - 2 * (m @ c.T) + cc[None, :], np.inf)
        best = d.argmin(axis=1)
        row = np.arange(len(level))
        slack = 1e-10 * (mm + cc.max()) + 1e-6
        ahead = d - d[row, best][:, None] - slack[:, None]
        lists = lists & (ahead <= 2 * apart[best] * (r * (1 + 1e-9) + 1e-6)[:, None])
        lists[row, best] = True
        single = lists.sum(axis=1) == 1
        balls.append((level[single], best[single]))
        end = ~single & (tree["left"][level] < 0)
        for i in np.flatnonzero(end):
            a, b = int(tree["lo"][level[i]]), int(tree["hi"][level[i]])
            mine = np.flatnonzero(lists[i])
            for s in range(a, b, 4_096):
                e = min(b, s + 4_096)
                points.append(np.arange(s, e))
                winners.append(mine[exact_squares(x[s:e], entries[mine]).argmin(axis=1)])
            compared += (b - a) * len(mine)
        deeper = ~single & ~end
        lists = np.repeat(lists[deeper], 2, axis=0)
        level = np.stack([tree["left"][level[deeper]], tree["right"][level[deeper]]], axis=1).reshape(-1)
    nodes = np.concatenate([b[0] for b in balls]), np.concatenate([b[1] for b in balls])
    return [nodes], np.concatenate(points), np.concatenate(winners), compared


def gathered(tree: dict[str, np.ndarray], x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the points of each entry, from cached balls and single points."""
    [(nodes, of)], points, winners, _ = owned(tree, x, entries)
    count = np.bincount(of, tree["hi"][nodes] - tree["lo"][nodes], len(entries)).astype(np.int64) + np.bincount(winners, minlength=len(entries))
    total = np.zeros(entries.shape, np.int64)
    np.add.at(total, of, tree["sum"][nodes])
    np.add.at(total, winners, x[points])
    return count, total


def assigned(tree: dict[str, np.ndarray], x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The entry of every point (in the tree's order)."""
    [(nodes, of)], points, winners, _ = owned(tree, x, entries)
    out = np.empty(len(x), np.int64)
    out[points] = winners
    for i, e in zip(nodes, of, strict=True):
        out[tree["lo"][i] : tree["hi"][i]] = e
    return out


# ---- over all vectors -------------------------------------------------------------------------------


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def trees(rows: DataFrame, size: int, parts: int, n: int, leaf: int, block: int) -> DataFrame:
    """(ids, labels, data): a row per block of vectors, its vectors and trees as numpy archive."""
    block = max(1, min(block, BLOCK_NUMBERS // max(1, size)))
    kind = rows.schema["label"].dataType.simpleString()
    tasks = max(-(-n // (2 * block)), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // 1_024)), 1)

    def block_of(t: pa.Table) -> pa.RecordBatch:
        x = matrix(t.column("raw").to_pylist(), size)
        arrays = {"x": x.astype(np.int32)}
        for p, cut in enumerate(cuts(size, parts)):
            arrays |= {f"{k}{p}": v for k, v in tree_of(x[:, cut], leaf).items()}
        one = pa.array([0, t.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(one, t.column(c).combine_chunks()) for c in ("id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([packed(arrays)], pa.binary())], ["ids", "labels", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            while sum(t.num_rows for t in waiting) >= block:
                t = pa.concat_tables(waiting)
                yield block_of(t.slice(0, block))
                waiting = [t.slice(block)]
        t = pa.concat_tables(waiting) if waiting else None
        if t is not None and t.num_rows:
            yield block_of(t)

    dealt = rows.repartition(tasks, F.xxhash64("id", "raw")).select("id", "label", "raw")
    return stored(dealt.mapInArrow(run, f"ids array<long>, labels array<{kind}>, data binary"), "trees")


def opened(data: bytes, p: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The tree of a part; its points' order is applied by the caller."""
    arrays = np.load(io.BytesIO(data))
    return {k: arrays[f"{k}{p}"] for k in ("order", "lo", "hi", "left", "right", "sum", "centre", "radius")}, arrays["x"]


def new_entries(blocks: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The entries after one round: floor of the mean of their points; unused ones stay."""
    parts = cuts(size, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [np.zeros(len(b), np.int64) for b in books], [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for data in batch.column("data"):
                for p, cut in enumerate(parts):
                    tree, x = opened(data.as_py(), p)
                    n, s = gathered(tree, x[tree["order"], cut].astype(np.int64), books[p])
                    counts[p] += n
                    totals[p] += s
        for p, (n, s) in enumerate(zip(counts, totals, strict=True)):
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(n[used]), pa.array(list(s[used]), pa.list_(pa.int64()))],
                ["part", "entry", "n", "s"],
            )

    sums = blocks.select("data").mapInArrow(run, "part int, entry int, n long, s array<long>")
    long = sums.select("part", "entry", "n", F.posexplode("s").alias("pos", "v")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    out = [b.copy() for b in books]
    for r in long.collect():  # a number per component of the codebooks
        out[r.part][r.entry, r.pos] = r.v // r.n
    return out


def coded(blocks: DataFrame, books: list[np.ndarray], size: int, kind: str) -> DataFrame:
    """(id, label, code, error) of every vector."""
    parts = cuts(size, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("data")[i].as_py()
                codes, error = [], 0
                for p, cut in enumerate(parts):
                    tree, x = opened(data, p)
                    own = np.empty(len(x), np.int64)
                    own[tree["order"]] = assigned(tree, x[tree["order"], cut].astype(np.int64), books[p])
                    codes.append(own)
                    error = error + ((x[:, cut].astype(np.int64) - books[p][own]) ** 2).sum(axis=1)
                text = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, axis=1).tolist()]
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in ("ids", "labels"))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text), pa.array(error)], ["id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"id long, label {kind}, code string, error long")


def digest_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", leaf: int = LEAF, block: int = BLOCK,
) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """Codes of all vectors: (id, code, error, label_error, codebooks_sha256), and the codebooks.

    Components become floor(scale * x).  Codebooks start as the parts of the ``entries`` vectors with the
    smallest ids (equal ids by their components, missing ids last; fewer vectors give fewer entries).  At most 256 entries, so that
    a code has two hex digits a part.  Vectors that are missing or hold missing or non-finite
    components are left out; repeated rows count as often as they stand there.  Vectors of different lengths are
    compressed apart, with codebooks of their own; a length that the parts don't divide gives
    the first parts one component more, an empty vector has empty parts and error 0.  label_error
    is the error summed over equal labels, missing ones together, of all lengths.  Codebooks are by length.
    """
    if not 1 <= entries <= 256:
        raise ValueError("1 to 256 entries")
    rows = stored(integer_vectors(vectors, scale, id_col, vector_col, label_col), "integers")
    kind = rows.schema["label"].dataType.simpleString()
    codebooks: dict[int, list[np.ndarray]] = {}
    out = None
    for size, n in sorted((r["size"], r.n) for r in rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row per length
        mine = rows.where(F.col("size") == size)
        first = matrix([bytes(r.raw) for r in mine.orderBy(F.asc_nulls_last("id"), "raw").limit(entries).select("raw").collect()], size)
        books = [first[:, cut] for cut in cuts(size, parts)]
        blocks = trees(mine, size, parts, n, leaf, block)
        for _ in range(rounds):
            books = new_entries(blocks, books, size)
        codebooks[size] = books
        part = coded(blocks, books, size, kind).withColumn("codebooks_sha256", F.lit(digest_of(books)))
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    out = stored(out, "codes")
    return with_label_errors(out).select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256"), codebooks


def with_label_errors(coded_rows: DataFrame) -> DataFrame:
    sums = stored(coded_rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    if sums.count() <= BROADCAST_ROWS:
        return coded_rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    dealt = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a hot label is dealt
    salted = coded_rows.withColumn("_s", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_s") == F.col("_salt"))).drop("_label", "_s", "_salt")


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same codes in SQL: every part against every entry, round by round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
n{r} AS MATERIALIZED (
  SELECT p.vec_id, p.part, min((list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x))::BIGINT * 256 + c.entry) AS m
  FROM p JOIN c{r} c ON p.part = c.part GROUP BY p.vec_id, p.part)""")
        if r < rounds:
            steps.append(f"""
u{r} AS (
  SELECT part, m % 256 AS entry, i, floor(sum(x[i]) / count(*)) AS v
  FROM n{r} JOIN p USING (vec_id, part), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(g.x, c.x) AS x
  FROM c{r} c LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS x FROM u{r} GROUP BY part, entry) g ON c.part = g.part AND c.entry = g.entry)""")
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, part, list_slice(e, part * len(e) // {parts} + 1, (part + 1) * len(e) // {parts}) AS x
  FROM v, LATERAL (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (
  SELECT part, entry, x FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p) WHERE entry < {entries}),
{",".join(steps)},
codes AS (SELECT vec_id, string_agg(printf('%02x', (m % 256)::INTEGER), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error FROM n{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: y::BIGINT), ','), ',' ORDER BY part, entry)) AS h FROM c{rounds})
SELECT v.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM codes JOIN v ON codes.vec_id = v.vec_id, books
"""


CODES_SQL = codes_sql()
