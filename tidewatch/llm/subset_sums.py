"""Hard negatives by exact inner products from subset-sum tables (the method of Four Russians).

Components are whole numbers.  A candidate is kept as bit planes: byte g of plane b holds bit b of its
components 8 g to 8 g + 7 (two's complement, so the highest plane counts negative).  For an anchor
a table per eight components holds the sums of all 256 subsets of its components there.  The
inner product is then one lookup per byte: the lookups of a plane are added, planes are shifted and added.

Candidates are dealt by hash to slots of bounded size and stay there; anchors (the stated query set)
visit every slot in a stream, which is the whole work once, in blocks.  A slot answers with its
best rows per anchor, and these are merged.  First pass: an anchor's positives, scored only against the
rows of its label.  Second pass: for each positive the best rows of other labels in the window
that its score sets.  No label or anchor is gathered in one task, so hot labels need no care.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from tidewatch.llm.common import stored
from tidewatch.llm.integers import integer_vectors

SCALE = 256
#: Candidates of a slot, and bytes of their numbers at most.
SLOT, SLOT_BYTES = 200_000, 200_000_000
#: Anchors scored together, and candidates of a tile.
TOGETHER, TILE = 32, 8_192


def planes_of(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(planes, groups, rows) bytes of integer rows and the number of planes, the last of which is the sign."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    n = max((-low - 1).bit_length() if low < 0 else 0, high.bit_length()) + 1
    groups = -(-x.shape[1] // 8)
    out = np.zeros((n, groups, len(x)), np.uint8)
    for b in range(n):
        bits = ((x >> b) & 1).astype(np.uint8)
        out[b] = np.packbits(bits, axis=1, bitorder="little").T
    return out, n


def tables_of(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): sums of the subsets of eight components."""
    groups = -(-anchors.shape[1] // 8)
    a = np.zeros((groups, 8, len(anchors)), np.int64)
    a.reshape(groups * 8, -1)[: anchors.shape[1]] = anchors.T
    out = np.zeros((groups, 256, len(anchors)), np.int64)
    for bit in range(8):  # the subsets with this bit on top of those below it
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + a[:, bit][:, None, :]
    return out


def scores_of(planes: np.ndarray, tables: np.ndarray, rows: slice) -> np.ndarray:
    """(rows, anchors): exact inner products."""
    n, groups, _ = planes.shape
    total = None
    for b in range(n - 1, -1, -1):  # Horner: twice what is above, plus this plane
        plane = tables[0][planes[b, 0, rows]] if groups else 0
        for g in range(1, groups):
            plane = plane + tables[g][planes[b, g, rows]]
        total = -plane if total is None else (total << 1) + plane
    return total


class Slot:
    """The candidates of a slot, by label, number and id."""

    def __init__(self, rows: pa.Table, width: int) -> None:
        self.uid = rows.column("uid").to_numpy()
        self.id = rows.column("id").to_numpy()
        self.label = rows.column("code").to_numpy()
        order = np.lexsort((self.uid, self.id, self.label))
        self.uid, self.id, self.label = self.uid[order], self.id[order], self.label[order]
        self.planes, self.n = planes_of(wide(rows.column("raw").to_pylist(), width)[order])

    def label_rows(self, code: int) -> slice:
        return slice(int(np.searchsorted(self.label, code, "left")), int(np.searchsorted(self.label, code, "right")))


def wide(raw: list[bytes], width: int) -> np.ndarray:
    """Integer rows, shorter ones filled with zeros."""
    out = np.zeros((len(raw), width), np.int64)
    for i, r in enumerate(raw):
        x = np.frombuffer(r, dtype="<i4")
        out[i, : len(x)] = x
    return out


def best(score: np.ndarray, ids: np.ndarray, uids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` by falling score, id, uid; ties are all looked at."""
    if len(score) > most:
        least = np.partition(score, len(score) - most)[len(score) - most]
        near = np.flatnonzero(score >= least)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((uids[near], ids[near], -score[near]))][:most]


def visits(candidates: DataFrame, anchors: DataFrame, slots: int, width: int, answer: Callable, schema: str) -> DataFrame:
    """``answer(slot, anchor rows)`` for every slot and batch of anchors.  ``anchors`` has the columns of
    ``candidates`` and more; each goes to every slot, candidates move once."""
    extra = [c for c in anchors.columns if c not in candidates.columns]
    kinds = {f.name: f.dataType for f in anchors.schema.fields}
    own = candidates.select(F.pmod(F.xxhash64("uid"), F.lit(slots)).cast("int").alias("slot"), F.lit(0).alias("visitor"), *candidates.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in extra])
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(1).alias("visitor"), *candidates.columns, *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, at, waiting = None, -1, []
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            number, visitor = t.column("slot").to_numpy(), t.column("visitor").to_numpy()
            cut = np.flatnonzero((number[1:] != number[:-1]) | (visitor[1:] != visitor[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), t.num_rows], strict=True):
                rows = t.slice(a, b - a)
                if number[a] != at:
                    slot, at, waiting = None, int(number[a]), []
                if visitor[a] == 0:
                    waiting.append(rows)
                    continue
                if slot is None and waiting:
                    slot, waiting = Slot(pa.concat_tables(waiting), width), []
                if slot is not None:  # else no candidate in this slot
                    for i in range(0, rows.num_rows, TOGETHER):
                        out = answer(slot, rows.slice(i, TOGETHER))
                        if out is not None:
                            yield from out.to_batches()

    dealt = own.unionAll(asked).repartition(slots, "slot").sortWithinPartitions("slot", "visitor", "code", "uid")
    return dealt.mapInArrow(run, schema)


def positives_of(candidates: DataFrame, anchors: DataFrame, slots: int, width: int, most: int) -> DataFrame:
    """(uid, p_uid, p_id, p_score, p_rank): the first other rows of an anchor's label."""

    def answer(slot: Slot, rows: pa.Table) -> pa.Table | None:
        uid, code = rows.column("uid").to_numpy(), rows.column("code").to_numpy()
        x = wide(rows.column("raw").to_pylist(), width)
        out: list[tuple] = []
        for c in np.unique(code):
            mine, span = np.flatnonzero(code == c), slot.label_rows(int(c))
            if span.stop == span.start:
                continue
            tables = tables_of(x[mine])
            found: list[list[tuple]] = [[] for _ in mine]
            for lo in range(span.start, span.stop, TILE):
                tile = slice(lo, min(span.stop, lo + TILE))
                score = scores_of(slot.planes, tables, tile)
                for k, a in enumerate(mine):
                    for i in best(score[:, k], slot.id[tile], slot.uid[tile], most + 1):  # one may be the anchor itself
                        if slot.uid[tile][i] != uid[a]:
                            found[k].append((-int(score[i, k]), int(slot.id[tile][i]), int(slot.uid[tile][i])))
            for k, a in enumerate(mine):
                out += [(int(uid[a]), u, i, -s) for s, i, u in sorted(found[k])[:most]]
        return pa.table([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["uid", "p_uid", "p_id", "p_score"]) if out else None

    found = visits(candidates, anchors, slots, width, answer, "uid long, p_uid long, p_id long, p_score long")
    order = Window.partitionBy("uid").orderBy(F.desc("p_score"), "p_id", "p_uid")
    return found.withColumn("p_rank", F.row_number().over(order)).where(F.col("p_rank") <= most)


def negatives_of(candidates: DataFrame, asked: DataFrame, slots: int, width: int, most: int, low: int, high: int) -> DataFrame:
    """(uid, p_rank, n_uid, n_id, n_score, rank): rows of other labels in the window of each positive."""

    def answer(slot: Slot, rows: pa.Table) -> pa.Table | None:
        uid, code = rows.column("uid").to_numpy(), rows.column("code").to_numpy()
        wanted = [v.as_py() for v in rows.column("positives")]
        tables = tables_of(wide(rows.column("raw").to_pylist(), width))
        found: list[dict[int, list[tuple]]] = [{p["p_rank"]: [] for p in w} for w in wanted]
        for lo in range(0, len(slot.uid), TILE):
            tile = slice(lo, min(len(slot.uid), lo + TILE))
            ids, uids, labels = slot.id[tile], slot.uid[tile], slot.label[tile]
            score = scores_of(slot.planes, tables, tile)
            for k, positives in enumerate(wanted):
                mine = score[:, k]
                other = labels != code[k]
                for p in positives:
                    if (p_score := p["p_score"]) < 0:  # an empty window
                        continue
                    # 100 * score in [low * p, high * p], on whole numbers
                    inside = np.flatnonzero(other & (mine >= -(-low * p_score // 100)) & (mine <= high * p_score // 100))
                    for i in inside[best(mine[inside], ids[inside], uids[inside], most)]:
                        found[k][p["p_rank"]].append((-int(mine[i]), int(ids[i]), int(uids[i])))
        out = [(int(uid[k]), r, u, i, -s) for k, by in enumerate(found) for r, rows_of in by.items() for s, i, u in sorted(rows_of)[:most]]
        return pa.table([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["uid", "p_rank", "n_uid", "n_id", "n_score"]) if out else None

    found = visits(candidates, asked, slots, width, answer, "uid long, p_rank long, n_uid long, n_id long, n_score long")
    order = Window.partitionBy("uid", "p_rank").orderBy(F.desc("n_score"), "n_id", "n_uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", slot_rows: int | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the inner product with the anchor; higher scores come
    first, ties by smaller id.  Anchors are the rows whose id is divisible by ``every``; their
    positives are the first other rows of their label.  For each positive the first rows of other labels
    with low * positive <= 100 * negative <= high * positive are returned; a negative positive
    score leaves no room and gives no rows.  Rows without an id, label or vector, or with
    missing or non-finite components take no part.  Rows that repeat an id are rows of their own (an
    anchor that stands twice is answered twice, and is the other's positive).  Missing places of a shorter
    vector count as 0.  Labels that are not whole numbers are told apart by 64-bit hashes.  Other columns
    are ignored.
    """
    rows = integer_vectors(vectors.where(F.col(label_col).isNotNull()), scale, id_col, vector_col, label_col).where("id IS NOT NULL")
    whole = isinstance(rows.schema["label"].dataType, (ByteType, ShortType, IntegerType, LongType))
    code = F.col("label").cast("long") if whole else F.xxhash64("label")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("uid"), "id", code.alias("code"), "size", "raw"), "integers")
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("width")).first()
    width = max(1, about.width or 0)
    slot_rows = max(1, min(slot_rows or SLOT, SLOT_BYTES // (8 * width)))
    slots = max(1, -(-about.n // slot_rows), min(rows.sparkSession.sparkContext.defaultParallelism, -(-about.n // 2_000)))
    candidates = rows.select("uid", "id", "code", "raw")
    anchors = candidates.where(F.col("id") % every == 0)
    found = stored(positives_of(candidates, anchors, slots, width, positives), "positives")
    lists = found.groupBy("uid").agg(F.collect_list(F.struct("p_rank", "p_score")).alias("positives"))  # ``positives`` at most
    asked = anchors.join(lists, "uid")
    last = negatives_of(candidates, asked, slots, width, negatives, low, high)
    names = anchors.select("uid", F.col("id").alias("anchor_id"))
    out = last.join(found.select("uid", F.col("p_rank").cast("long").alias("p_rank"), "p_id", "p_score"), ["uid", "p_rank"]).join(names, "uid")
    return out.select("anchor_id", F.col("p_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("n_id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """Where the id is divisible by 7, the label is the next one of ten."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


NEGATIVES_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score
  FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
