"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Sketch: in round i every element of a set is hashed to one of ``COORDINATES`` bins and to a value in
[0, 1); a bin keeps the smallest i + value it has seen.  Rounds go on until no bin is empty; after as
many rounds as bins, round i puts all elements into bin i - COORDINATES, so twice as many rounds fill
every coordinate.  A coordinate agrees for two sets with probability equal to their Jaccard
similarity, with concentration as if the coordinates were independent.

Search: equal sets are one node.  Sketches are cut into ``BANDS`` bands; nodes that agree in a band
share its bucket.

1. In each bucket the smallest node is the centre; every node is verified exactly against the two
   centres it shares most bands with, and the links found are joined to components.
2. A link between two components can only be between members of a bucket that holds both.  In such
   buckets all members of different components that agree in at least two bands, and in this band
   first, are compared in tasks of bounded size: first by bands, to see whose full sets are needed,
   then on the full sets.  Only links leave a task, never candidate pairs.

A pair of similarity 0.8 shares fewer than two of 64 bands of 6 with a probability below 1e-7.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import components, in_blocks, over_batches, over_groups, stored, text_of
from tidewatch.llm.words import Words, in_slices

BANDS = 64
BAND_ROWS = 6
COORDINATES = BANDS * BAND_ROWS
#: Bands that two nodes must share before they are compared.
SHARED = 2
#: Members of a bucket that meet in one task.
BLOCK = 1_500
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of the ``k``-word shingles of each text."""
    import xxhash

    of_word = np.array([xxhash.xxh3_64_intdigest(w) for w in words.words.to_pylist()], dtype=np.uint64)
    flat = of_word[words.codes] if len(of_word) else np.zeros(0, dtype=np.uint64)
    joined = mixed(flat + np.uint64(1))
    for i in range(1, k):
        joined = mixed(joined[:-1] * np.uint64(GOLD) + flat[i:]) if len(joined) > 1 else joined[:0]
    out = []
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(joined[a : b - k + 1]))
        elif b > a:  # fewer words: the whole sequence is the only shingle
            h = np.full(1, b - a, dtype=np.uint64)
            for w in flat[a:b]:
                h = mixed(h * np.uint64(3) + w)
            out.append(h)
        else:
            out.append(flat[:0])
    return out


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """One row per set, without an empty coordinate for sets that have an element."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), coordinates), empty)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    flat = out.reshape(-1)
    for i in range(2 * coordinates):
        if not len(elements):
            break
        h = mixed(elements + np.uint64((GOLD * (i + 1)) & 0xFFFFFFFFFFFFFFFF))
        value = (np.uint64(i) << np.uint64(40)) | (h >> np.uint64(24))
        bins = ((h & np.uint64(0xFFFFFF)) * np.uint64(coordinates) >> np.uint64(24)).astype(np.int64) if i < coordinates else np.full(len(h), i - coordinates)
        np.minimum.at(flat, owner * coordinates + bins, value)
        open_sets = (out == empty).any(axis=1)
        if not open_sets.all():
            stay = open_sets[owner]
            owner, elements = owner[stay], elements[stay]
    return out


def bands_of(sketch: np.ndarray) -> np.ndarray:
    """One 32-bit number per band, int32."""
    parts = sketch.reshape(len(sketch), -1, BAND_ROWS)
    h = np.zeros(parts.shape[:2], dtype=np.uint64)
    for i in range(BAND_ROWS):
        h = mixed(h * np.uint64(GOLD) + parts[:, :, i])
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def digest_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def sketched(rows: DataFrame, k: int) -> DataFrame:
    """(id, n, digest, bands) per row of (id, text)."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for piece, words in in_slices(batch):
            sets = shingle_sets(words, k)
            for a in range(0, len(sets), 256):
                some = sets[a : a + 256]
                bands = bands_of(sketches(some))
                digest = [digest_of(s.tobytes()) for s in some]
                flat = pa.FixedSizeListArray.from_arrays(pa.array(bands.reshape(-1)), BANDS).cast(pa.list_(pa.int32()))
                out.append(pa.table([piece.column("id").slice(a, len(some)), pa.array([len(s) for s in some], pa.int64()), pa.array(digest, pa.binary()), flat], names=["id", "n", "digest", "bands"]))
        return pa.concat_tables(out)

    return over_batches(rows, run, "id long, n long, digest binary, bands array<int>")


def full_sets(rows: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(rep, elements): the whole shingle sets of ``nodes`` (rep, digest), made again from the texts;
    only a few documents share a bucket, so sets are neither stored nor moved for all."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        out = []
        for piece, words in in_slices(batch):
            data = [s.tobytes() for s in shingle_sets(words, k)]
            own = pa.array([digest_of(d) for d in data], pa.binary())
            out.append(pa.table([piece.column("id"), own, pa.array(data, pa.binary())], names=["rep", "own", "elements"]).filter(pc.equal(own, piece.column("digest"))))
        return pa.concat_tables(out)

    mine = rows.join(nodes.select(F.col("rep").alias("id"), "digest"), "id").select("id", "digest", "text")
    return over_batches(mine, run, "rep long, own binary, elements binary").groupBy("rep").agg(F.first("elements").alias("elements"))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda n: sets.select(F.col("rep").alias(n), F.col("elements").alias(f"set_{n}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()
        keep = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(left, right, strict=True)]
        return batch.select(["a", "b"]).filter(pa.array(keep))

    return over_batches(both.select("a", "b", "set_a", "set_b"), check, "a long, b long")


def candidates(rows: pa.Table, lo: int, hi: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a group (one bucket, one pair of blocks) that have to be compared."""
    n = hi - lo
    bands = np.array(rows.column("bands").slice(lo, n).combine_chunks().flatten()).reshape(n, BANDS)
    comp, size, side = (rows.column(c).slice(lo, n).to_numpy() for c in ("comp", "n", "side"))
    band = int(rows.column("bucket")[lo].as_py()) >> 32
    crossed = rows.column("left")[lo].as_py() != rows.column("right")[lo].as_py()
    first, second = [], []
    for a in range(0, n, 128):
        part = slice(a, min(n, a + 128))
        shared = np.zeros((part.stop - part.start, n), dtype=np.int16)
        earlier = np.zeros(shared.shape, dtype=bool)
        for i in range(BANDS):
            same = bands[part, i][:, None] == bands[:, i][None, :]
            shared += same
            if i < band:
                earlier |= same
        fit = (shared >= SHARED) & ~earlier & (comp[part][:, None] != comp[None, :])
        fit &= 100 * np.minimum(size[part][:, None], size[None, :]) >= percent * np.maximum(size[part][:, None], size[None, :])
        if crossed:
            fit &= side[part][:, None] != side[None, :]
        x, y = np.nonzero(fit)
        keep = y > x + a
        first.append(x[keep] + a)
        second.append(y[keep])
    return np.concatenate(first), np.concatenate(second)


def common_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (x, y)."""
    if len(x) <= 64:
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y, strict=True)], dtype=np.int64)
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(elements, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
    out = np.zeros(len(x), dtype=np.int64)
    width = 2_048
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    for a in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        part = slice(*np.searchsorted(code, [a, a + width]))
        has = np.zeros((len(sets), width), dtype=np.float32)
        has[owner[part], code[part] - a] = 1
        out += (has @ has.T)[x, y].astype(np.int64)
    return out


def spanning(x: np.ndarray, y: np.ndarray, names: np.ndarray) -> list[int]:
    """Indices of links that join what earlier ones left apart; ends are known by ``names``."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            parent[i] = parent.get(p, p)
            i = p
        return i

    out = []
    for k, (a, b) in enumerate(zip(names[x].tolist(), names[y].tolist(), strict=True)):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append(k)
    return out


def node_links(reps: DataFrame, texts: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect every two nodes linked by a chain of verified links.

    ``reps``: (rep, digest, n, bands); ``texts``: (id, text)."""
    rows = reps.select("rep", F.posexplode("bands").alias("i", "v")).select(
        (F.shiftleft(F.col("i").cast("long"), 32) + F.col("v").cast("long") + F.lit(2**31)).alias("bucket"), "rep"
    )
    buckets = rows.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("_m")).where("_m > centre").drop("_m")
    placed = stored(rows.join(buckets, "bucket"), "buckets")
    shared = reps.select("rep", "digest").join(placed.select("rep").distinct(), "rep", "left_semi")
    sets = stored(full_sets(texts, shared, k), "sets")
    met = placed.where("rep <> centre").groupBy("rep", "centre").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= SHARED)
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("m"), "centre"))).where("r <= 2")
    star = verified(best.select(F.col("centre").alias("a"), F.col("rep").alias("b")), sets, percent)
    joined = stored(components(star), "joined")
    # buckets with more than one component
    known = placed.select("bucket", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("comp"))
    known = stored(known, "known")
    mixed_buckets = known.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    unsettled = known.join(mixed_buckets, "bucket", "left_semi").join(reps.select("rep", "n", "bands"), "rep")
    keys = ["bucket", "left", "right"]
    members = [*keys, "side", "rep", "comp", "n", "bands"]
    schema = "bucket long, left int, right int, side int, rep long, comp long, n long, bands array<int>"

    def needed(t: pa.Table, starts: np.ndarray) -> pa.Table | None:
        out = []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo > 1:
                x, y = candidates(t, lo, hi, percent)
                if len(x):
                    out.append(np.unique(np.concatenate([x, y])) + lo)
        return t.select(members).take(pa.array(np.concatenate(out))) if out else None

    blocks = in_blocks(unsettled, "bucket", "rep", block)
    # members that have to be compared, with all that the comparison needs but their sets
    wanted = stored(over_groups(blocks.select(*members), keys, needed, schema), "wanted")
    found = compared(wanted, sets, keys, percent)
    return joined.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(found)


def compared(wanted: DataFrame, sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) between members of different components, from the full sets of each group."""

    def compare(t: pa.Table, starts: np.ndarray) -> pa.Table | None:
        a, b = [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            x, y = candidates(t, lo, hi, percent)
            if not len(x):
                continue
            own = [np.frombuffer(v, dtype=np.uint64) for v in t.column("elements").slice(lo, hi - lo).to_pylist()]
            size = np.array([len(s) for s in own])
            common = common_counts(own, x, y)
            hit = 100 * common >= percent * (size[x] + size[y] - common)
            x, y = x[hit], y[hit]
            rep, comp = (t.column(c).slice(lo, hi - lo).to_numpy() for c in ("rep", "comp"))
            for i in spanning(x, y, comp):
                a.append(int(rep[x[i]]))
                b.append(int(rep[y[i]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())}) if a else None

    full = wanted.join(sets, "rep").select(*wanted.columns, "elements")
    return over_groups(full, keys, compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: the id (as long), n_shingles, component_id and kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets (64-bit
    hashes); component_id is the smallest id reachable by links.  A text of fewer than ``k`` words is
    one shingle; one without words, or missing, is linked with nothing.  Rows that share an id
    but not a text stand for one node where they are the smallest of their sets; a row without an
    id is kept and has no component.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    table = stored(sketched(texts, k), "sketches")
    known = table.where("n > 0 AND id IS NOT NULL")
    reps = stored(known.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "reps")
    links = stored(node_links(reps, texts, k, percent, block), "links")
    found = components(links)
    labels = reps.select(F.col("digest").alias("_digest"), "rep").join(found, F.col("rep") == F.col("node"), "left").select("_digest", F.coalesce("component", "rep").alias("_component"))
    rows = table.select("id", "n", "digest").join(labels, F.col("digest") == F.col("_digest"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("_component")), F.col("id")))
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))
    )
