"""Repeated strings by common-prefix interval trees over partitioned suffix arrays.

A window is a string of ``LENGTH`` bytes.  Its anchor is the position of its smallest ``GRAM``-byte
hash, so equal windows have equal anchors; consecutive windows with one anchor form a fragment of at
most 2 * LENGTH bytes.  Fragments whose anchor hash occurs once hold no repeat and are dropped by
counting; the others are gathered by hash, each group in one task (groups of more than ``GROUP``
fragments are dealt to several, see below).  Of fragments with equal content (64-bit hashes of anchor
and content) all but the first repeat it from end to end and are spans to remove; only the first of
each content go on, and only where a group has several contents, with their bytes.

There the suffixes of the fragments form an enhanced suffix array: sorted by their first LENGTH
bytes (equality by hash, checked on the bytes) and, inside a class of equal ones, by what follows.
Scanning the longest common prefixes with a stack gives the interval tree.  An interval whose
suffixes are preceded by different bytes, or begin their fragment, cannot be extended to the left and
is a maximal repeat group: its length and all its occurrences.  Every occurrence but the first (by
document, then position) is a span to remove.  Each window that occurs earlier lies in such a span:
extending all its occurrences to the left, while they agree, ends in such an interval.

A group of more than ``GROUP`` fragments is dealt by document to parts.  An occurrence that has an
earlier one in its own part is settled there; of each window the first in every part goes on as a
128-bit hash, and the first of those, found by a window over at most one row per part, wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import over_batches, over_groups, stored, text_of

LENGTH = 100
GRAM = 32
#: Fragments of one anchor hash that meet in one task.
GROUP = 20_000
#: Bytes hashed at once; positions need so many low bits.
SLICE, SLICE_BITS = 1 << 18, np.uint64(19)

_RNG = np.random.default_rng(20_240)
_TABLES = [_RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_FACTORS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]


def _power(factor: int, n: int) -> np.uint64:
    return np.uint64(pow(factor, n, 1 << 64))


def rolling(data: np.ndarray, sizes: list[int], which: int = 0) -> dict[int, np.ndarray]:
    """Hashes of the strings of each power of two in ``sizes`` from every position they fit at."""
    h, n, out = _TABLES[which][data], 1, {}
    while True:
        if n in sizes:
            out[n] = h
        if n >= max(sizes) or len(h) <= n:
            return out
        h = h[:-n] * _power(_FACTORS[which], n) + h[n:]
        n *= 2


def binary_sizes(length: int) -> list[int]:
    return [1 << i for i in range(length.bit_length()) if length >> i & 1]


def hash_at(parts: dict[int, np.ndarray], at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Hash of the ``length`` bytes from each position of ``at``, from the hashes of powers of two."""
    out, offset = np.zeros(len(at), dtype=np.uint64), 0
    for n in reversed(binary_sizes(length)):
        out = out * _power(_FACTORS[which], n) + parts[n][at + offset]
        offset += n
    return out


def anchors(h: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window: the position of its anchor, and the mixed hash of every gram."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    low = ((h >> SLICE_BITS) << SLICE_BITS) | np.arange(len(h), dtype=np.uint64)
    width, n = length - gram + 1, 1
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    if n < width:
        low = np.minimum(low[: n - width], low[width - n :])
    return (low & ((np.uint64(1) << SLICE_BITS) - np.uint64(1))).astype(np.int64), h


def fragments_of(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, key, content, lo, count) of the fragments of all texts: ``count`` windows from ``lo``;
    the first and the last of them cover the fragment, so their hashes make the content's."""
    out: list[tuple] = []
    held: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not held:
            return
        data = np.frombuffer(b"".join(d for _, _, d in held), dtype=np.uint8)
        sizes = np.array([len(d) for _, _, d in held])
        begin = np.cumsum(sizes) - sizes
        parts = rolling(data, [*binary_sizes(length), gram])
        anchor, h = anchors(parts[gram], length, gram)
        owner = np.repeat(np.arange(len(held)), sizes)[: len(anchor)]
        valid = np.arange(len(anchor)) + length <= (begin + sizes)[owner]
        at = np.flatnonzero(valid)
        if len(at):
            opens = np.append(True, (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
            first = np.flatnonzero(opens)
            count = np.diff(np.append(first, len(at)))
            start = at[first]
            content = hash_at(parts, start, length) * np.uint64(_FACTORS[1]) + hash_at(parts, start + count - 1, length) + count.astype(np.uint64)
            out.append((np.array([t for t, _, _ in held])[owner[start]], h[anchor[start]].view(np.int64), content.view(np.int64), start - begin[owner[start]] + np.array([o for _, o, _ in held])[owner[start]], count))
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for o in range(0, len(t) - length + 1, SLICE - length):  # slices of a long text share length - 1 bytes
            piece = t[o : o + SLICE - 1]
            if size + len(piece) > SLICE:
                flush()
                size = 0
            held.append((i, o, piece))
            size += len(piece)
    flush()
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_fragments(rows: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """(doc, h, lo, count, key, part, dealt, first, several): the fragments of repeated anchor hashes.
    ``first`` of their content in their part of the group; ``several``: the group needs its bytes."""

    def tell(batch: pa.RecordBatch) -> pa.RecordBatch:
        text, key, content, lo, count = fragments_of(batch.column("text").cast(pa.binary()).to_pylist(), length, gram)
        at = pa.array(text)
        columns = [batch.column("doc").take(at), batch.column("h").take(at), pa.array(key), pa.array(content), pa.array(lo, pa.int32()), pa.array(count, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["doc", "h", "key", "content", "lo", "count"])

    def keys_only(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, n = np.unique(fragments_of(batch.column("text").cast(pa.binary()).to_pylist(), length, gram)[1], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(n, pa.int32())], ["key", "n"])

    counted = over_batches(rows.select("text"), keys_only, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    several = counted.where("n > 1").select("key", F.ceil(F.col("n") / group).cast("int").alias("parts"))
    found = over_batches(rows, tell, "doc long, h long, key long, content long, lo int, count int").join(several, "key")
    dealt = found.withColumn("part", F.pmod(F.xxhash64("doc", "h"), F.col("parts")).cast("int")).repartition("key", "part")
    here = Window.partitionBy("key", "part")
    first = F.rank().over(Window.partitionBy("key", "part", "content").orderBy("doc", "h", "lo")) == 1
    kinds = F.min("content").over(here) != F.max("content").over(here)
    marked = dealt.withColumn("first", first).withColumn("kinds", kinds).withColumn("dealt", F.col("parts") > 1)
    return stored(marked.select("doc", "h", "lo", "count", "key", "part", "dealt", "first", (F.col("kinds") | F.col("dealt")).alias("several")), "fragments")


class SuffixArray:
    """The enhanced suffix array of the fragments of some groups.

    Only suffixes of classes that can open a maximal repeat are sorted: classes (equal first
    ``length`` bytes, one group) of two and more with different bytes in front, or at the start of a
    fragment."""

    def __init__(self, group: np.ndarray, count: np.ndarray, data: list[bytes], place: np.ndarray, length: int):
        self.length = length
        sizes = np.array([len(d) for d in data])
        self.flat = np.frombuffer(b"".join(data) + b"\0" * 80, dtype=np.uint8)
        begin = np.cumsum(sizes) - sizes + 1  # behind the byte in front
        self.fragment = np.repeat(np.arange(len(data)), count)
        inner = np.arange(len(self.fragment)) - np.repeat(np.cumsum(count) - count, count)
        self.at = begin[self.fragment] + inner
        self.inner = inner
        #: Order of the occurrences: by document, then position.
        self.place = place[self.fragment] + inner
        self.tail = count[self.fragment] - 1 - inner
        h = hash_at(rolling(self.flat, binary_sizes(length)), self.at, length) ^ (group[self.fragment].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(h, kind="stable")
        opens = np.append(True, h[order[1:]] != h[order[:-1]])
        self.of_class = np.empty(len(h), dtype=np.int64)
        self.of_class[order] = np.cumsum(opens) - 1
        starts = np.flatnonzero(opens)
        before = np.where(inner == 0, 256, self.flat[self.at - 1].astype(np.int64))[order]
        self.before = np.empty(len(h), dtype=np.int64)
        self.before[order] = before
        low, high = np.minimum.reduceat(before, starts), np.maximum.reduceat(before, starts)
        n = np.diff(np.append(starts, len(h)))
        wanted = (n > 1) & ((low != high) | (high == 256))
        self.suffixes = self._sorted(order[np.repeat(wanted, n)])

    def _sorted(self, s: np.ndarray) -> np.ndarray:
        if not len(s):
            self.prefix = np.zeros(0, dtype=np.int64)
            return s
        rest = np.arange(max(8, -(-int(self.tail[s].max()) // 8) * 8))  # the longest tail, in whole words
        tails = self.flat[np.minimum(self.at[s][:, None] + self.length + rest, len(self.flat) - 1)]
        tails = np.where(rest < self.tail[s][:, None], tails, 0).astype(np.uint8)
        words = np.ascontiguousarray(tails).view(">u8").astype(np.uint64)
        order = np.lexsort((self.tail[s], *words.T[::-1], self.of_class[s]))
        s, tails = s[order], tails[order]
        same = self.of_class[s[1:]] == self.of_class[s[:-1]]
        fronts = np.lib.stride_tricks.sliding_window_view(self.flat, self.length)
        for a in range(0, len(same), 50_000):  # the hash said equal: see for yourself
            part = slice(a, a + 50_000)
            same[part] &= (fronts[self.at[s[1:][part]]] == fronts[self.at[s[:-1][part]]]).all(axis=1)
        differ = tails[1:] != tails[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), len(rest))
        common = np.minimum(common, np.minimum(self.tail[s[1:]], self.tail[s[:-1]]))
        self.prefix = np.where(same, self.length + common, 0)
        return s

    def intervals(self) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of the nodes of the interval tree with at least ``length`` bytes,
        left-diverse ones only, children before parents."""
        before = self.before[self.suffixes].tolist()
        stack: list[list] = []  # [prefix, first row, byte in front or -1 if diverse]
        least = self.length

        def one(i: int) -> int:
            return -1 if before[i] == 256 else before[i]

        for i, p in enumerate([*self.prefix.tolist(), 0]):
            first, front = i, one(i)
            while stack and stack[-1][0] > p:
                top = stack.pop()
                if top[2] != front:
                    top[2] = -1
                if top[2] == -1:
                    yield top[0], top[1], i
                first, front = top[1], top[2]
            if p >= least:
                if stack and stack[-1][0] == p:
                    if stack[-1][2] != front:
                        stack[-1][2] = -1
                else:
                    stack.append([p, first, front])

    def removed(self) -> np.ndarray:
        """Per suffix the length of the longest repeat that has an earlier occurrence (0: none)."""
        out = np.zeros(len(self.suffixes), dtype=np.int64)
        place = self.place[self.suffixes]
        small, longest = place.tolist(), out.tolist()
        for p, first, last in self.intervals():
            if last - first < 64:
                least = min(small[first : last + 1])
                for i in range(first, last + 1):
                    if small[i] != least and longest[i] < p:
                        longest[i] = p
            else:
                rows = slice(first, last + 1)
                mine = np.array(longest[rows])
                longest[rows] = np.where(place[rows] != place[rows].min(), np.maximum(mine, p), mine).tolist()
        return np.array(longest, dtype=np.int64)


def _prepared(t: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number and a number per row that orders documents and positions."""
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ids, h, lo = (t.column(c).to_numpy() for c in ("doc", "h", "lo"))
    order = np.lexsort((h, ids))
    new = np.append(True, (ids[order[1:]] != ids[order[:-1]]) | (h[order[1:]] != h[order[:-1]]))
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(new) - 1
    return group, (rank << 32) + lo


def repeat_groups(t: pa.Table, starts: np.ndarray, length: int) -> pa.Table:
    """The maximal repeat groups of a table of fragments: (repeat, n_bytes, doc, h, start), a row
    per occurrence; ``repeat`` numbers the groups of the table."""
    group, place = _prepared(t, starts)
    s = SuffixArray(group, t.column("count").to_numpy().astype(np.int64), t.column("data").to_pylist(), place, length)
    number, size, rows = [], [], []
    for i, (p, first, last) in enumerate(s.intervals()):
        rows.append(s.suffixes[first : last + 1])
        number.append(np.full(last - first + 1, i))
        size.append(np.full(last - first + 1, p))
    at = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
    fragment = s.fragment[at]
    start = t.column("lo").to_numpy()[fragment] + s.inner[at]
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
    return pa.table({"repeat": join(number), "n_bytes": join(size), "doc": t.column("doc").to_numpy()[fragment], "h": t.column("h").to_numpy()[fragment], "start": start.astype(np.int64)})


def spans(fragments: DataFrame, length: int) -> DataFrame:
    """(doc, h, start, stop, w1, w2): spans to remove, and windows (w1, w2) of dealt groups that are
    the first of their part."""
    schema = "doc long, h long, start long, stop long, w1 long, w2 long"

    def find(t: pa.Table, starts: np.ndarray) -> pa.Table | None:
        group, place = _prepared(t, starts)
        count = t.column("count").to_numpy().astype(np.int64)
        s = SuffixArray(group, count, t.column("data").to_pylist(), place, length)
        doc, h, lo, dealt = (t.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "h", "lo", "dealt"))
        size = s.removed()
        hit = np.flatnonzero(size)
        at = s.suffixes[hit]
        start = lo[s.fragment[at]] + s.inner[at]
        out = [doc[s.fragment[at]], h[s.fragment[at]], start, start + size[hit], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)]
        if dealt.any():
            open_ = np.flatnonzero(dealt[s.fragment])
            # of each class the first occurrence
            order = open_[np.lexsort((s.place[open_], s.of_class[open_]))]
            first = order[np.append(True, s.of_class[order[1:]] != s.of_class[order[:-1]])]
            w = [hash_at(rolling(s.flat, binary_sizes(length), i), s.at[first], length, i).view(np.int64) for i in (0, 1)]
            start = lo[s.fragment[first]] + s.inner[first]
            more = [doc[s.fragment[first]], h[s.fragment[first]], start, np.full(len(first), -1), *w]
            out = [np.concatenate(x) for x in zip(out, more, strict=True)]
        return pa.table({n: x.astype(np.int64) for n, x in zip(["doc", "h", "start", "stop", "w1", "w2"], out, strict=True)})

    found = over_groups(fragments, ["key", "part"], find, schema, together=5_000_000)
    w = Window.partitionBy("w1", "w2")
    first = found.where("stop < 0").withColumn("_f", F.min(F.struct("doc", "h", "start")).over(w))
    late = first.where(F.struct("doc", "h", "start") != F.col("_f")).select("doc", "h", "start", (F.col("start") + length).alias("stop"))
    return found.where("stop >= 0").select("doc", "h", "start", "stop").unionAll(late)


def fragments_with_bytes(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(doc, h, key, part, lo, count, data, dealt): the ``wanted`` fragments with their bytes."""
    lists = wanted.groupBy(F.col("doc").alias("_doc"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("lo", "key", "count", "part", "dealt")).alias("found"))
    joined = rows.join(lists, (F.col("doc") == F.col("_doc")) & (F.col("h") == F.col("_h")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                yield from cut_out(batch.slice(a, 500), length).to_batches()

    # all columns of ``rows``, so that the exchange of the texts is the one the last join uses
    return joined.select(*rows.columns, "found").mapInArrow(cut, "doc long, h long, key long, part int, lo int, count int, data binary, dealt boolean")


def cut_out(batch: pa.RecordBatch, length: int) -> pa.Table:
    """The fragments of a batch of documents with their bytes and the byte in front of them."""
    texts = batch.column("text").cast(pa.binary()).to_pylist()
    owner, key, lo, count, part, data, dealt = [], [], [], [], [], [], []
    for i, (text, found) in enumerate(zip(texts, batch.column("found").to_pylist(), strict=True)):
        for f in found:
            a = f["lo"]
            owner.append(i)
            key.append(f["key"])
            lo.append(a)
            count.append(f["count"])
            part.append(f["part"])
            dealt.append(f["dealt"])
            data.append((text[a - 1 : a] if a else b"\0") + text[a : a + f["count"] + length - 1])
    at = pa.array(owner, pa.int64())
    return pa.table({
        "doc": batch.column("doc").take(at), "h": batch.column("h").take(at), "key": pa.array(key, pa.int64()), "part": pa.array(part, pa.int32()), "lo": pa.array(lo, pa.int32()),
        "count": pa.array(count, pa.int32()), "data": pa.array(data, pa.binary()), "dealt": pa.array(dealt, pa.bool_()),
    })


def merged(spans_of: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as maximal runs; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans_of):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id (as long), n_bytes, n_removed, n_spans, kept_sha256 and
    ``removed`` (the maximal removed runs as start and stop).

    Removes each byte covered by a string of ``length`` bytes that starts earlier: in a document of
    a smaller id (a missing id is the smallest; documents that share an id go by a hash of their
    text), or earlier in the same document.  Equal rows (id and text) are one document, and each of
    them loses the same.  A missing text is empty.  Removal may cut a character.
    """
    missing = F.lit(-(2**63))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).select(F.coalesce("id", missing).alias("doc"), "text", F.col("id").isNull().alias("nameless"))
    shared = not rows.groupBy("doc").count().where("count > 1").isEmpty()
    rows = rows.withColumn("h", F.xxhash64("text") if shared else F.lit(0).cast("long"))
    fragments = repeated_fragments(rows.select("doc", "h", "text"), length, gram, group)
    stop = F.col("lo") + F.col("count") + (length - 1)
    copies = fragments.where("NOT first").select("doc", "h", F.col("lo").cast("long").alias("start"), stop.cast("long").alias("stop"))
    wanted = fragments.where("first AND several").select("doc", "h", "lo", "count", "key", "part", "dealt")
    found = copies.unionAll(spans(fragments_with_bytes(rows, wanted, length), length))
    lists = found.groupBy(F.col("doc").alias("_doc"), F.col("h").alias("_h")).agg(F.collect_set(F.struct("start", "stop")).alias("found"))
    joined = rows.join(lists, (F.col("doc") == F.col("_doc")) & (F.col("h") == F.col("_h")), "left")

    def cut(batch: pa.RecordBatch) -> pa.Table:
        n_bytes, n_removed, n_spans, sha, runs = [], [], [], [], []
        for text, found in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("found").to_pylist(), strict=True):
            gone = merged([(f["start"], f["stop"]) for f in found or ()])
            kept, at = hashlib.sha256(), 0
            for a, b in gone:
                kept.update(text[at:a])
                at = b
            kept.update(text[at:])
            n_bytes.append(len(text))
            n_removed.append(sum(b - a for a, b in gone))
            n_spans.append(len(gone))
            sha.append(kept.hexdigest())
            runs.append([{"start": a, "stop": b} for a, b in gone])
        numbers = [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
        return pa.table([batch.column("id"), *numbers, pa.array(sha), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    shown = joined.select(F.when(~F.col("nameless"), F.col("doc")).alias("id"), "text", "found")
    return over_batches(shown, cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,stop:long>>").withColumnRenamed("id", id_col)
