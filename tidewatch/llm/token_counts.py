"""Token counts of whole texts, huge ones by overlapping chunks that are spliced exactly.

Short texts are encoded whole.  Where the tokenizer is byte-level BPE with the usual pattern, a text
may be split before every space that a non-space follows (no word of the pattern goes across such a
point, and the white space before it is the same word with or without what follows), so equal parts
are encoded once per Python worker.  A text longer than one chunk and its overlap is cut into
windows [i*C, (i+1)*C + O); each window is encoded on its own, in whichever task it lands, with
offsets.  A window starts at an arbitrary character, so its first words may be cut wrongly; the
splice makes up for that:

* The pre-tokenizer's pattern has no look-behind, so from a word boundary on its result depends on
  the text to the right only.  A position that is a word boundary in two neighbouring windows is
  therefore followed by the same words in both.
* A boundary at least ``MARGIN`` characters before the right end of a window cannot depend on what
  lies beyond that end: the pattern looks at most two characters past a word, and an added token
  (which would split the text) fits into the margin.

The first common boundary with this margin is a proven splice point.  Where a pair of neighbours
has none (a word longer than the overlap), the document is encoded again with chunks and overlaps
eight times wider, until it fits into one window.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import kept_in_worker, over_batches, runs_of_text, stored, text_of

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
WIDEN = 8
#: Characters given to the library at once.
CALL_CHARS = 400_000

#: Distinct parts remembered by a Python worker.
KNOWN_PARTS = 500_000

_PART = re.compile(r"(?= \S)")
_ODD_SPACE = re.compile(r" (?:\s|\Z)")


def load(path: str):
    """The tokenizer, once per Python worker."""
    loaded = kept_in_worker("tokenizers")
    if path not in loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded[path] = Tokenizer.from_file(path)
    return loaded[path]


def margin(tokenizer) -> int:
    """Characters that a splice point keeps from the right end of its window."""
    return 8 + max([0, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])


def splits_at_spaces(tokenizer) -> bool:
    """Whether equal parts between spaces always give equal tokens."""
    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    added = all(" " not in t["content"] and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in spec["added_tokens"])
    return bool(plain and added and not spec.get("normalizer") and spec["model"].get("dropout") is None)


def counted(tokenizer, texts: list[str]) -> list[int]:
    out: list[int] = []
    for part in runs_of_text([len(t) for t in texts], CALL_CHARS):
        out += [len(e) for e in tokenizer.encode_batch_fast(texts[part], add_special_tokens=False)]
    return out


def parts_of(text: str) -> tuple[str, list[str]]:
    """The text up to its first split point, and the parts behind the points without their space."""
    if _ODD_SPACE.search(text):
        first, *rest = _PART.split(text)
        return first, [p[1:] for p in rest]
    first, *rest = text.split(" ")
    return first, rest


def counted_parts(tokenizer, parts: list[str]) -> list[int]:
    """Tokens of " " + part for each part, from few calls: such parts may stand behind each other."""
    out: list[int] = []
    for part in runs_of_text([len(p) + 1 for p in parts], CALL_CHARS):
        ends = np.cumsum([len(p) + 1 for p in parts[part]])
        begins = np.array(tokenizer.encode(" " + " ".join(parts[part]), add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
        out += np.diff(np.searchsorted(begins, ends), prepend=0).tolist()
    return out


def counted_by_part(tokenizer, texts: list[str], known: dict[str, int]) -> list[int]:
    out: list[int] = []
    for part in runs_of_text([len(t) for t in texts], 5 * CALL_CHARS):
        split = [parts_of(t) for t in texts[part]]
        firsts = counted(tokenizer, [f for f, _ in split])
        seen = [list(map(known.get, rest)) for _, rest in split]
        new = list({p for (_, rest), n in zip(split, seen, strict=True) if None in n for p, k in zip(rest, n, strict=True) if k is None})
        fresh = dict(zip(new, counted_parts(tokenizer, new), strict=True))
        for first, (_, rest), n in zip(firsts, split, seen, strict=True):
            out.append(first + (sum(fresh[p] if k is None else k for p, k in zip(rest, n, strict=True)) if None in n else sum(n)))
        if len(known) < KNOWN_PARTS:
            known.update(fresh)
    return out


def word_bounds(encoding) -> tuple[np.ndarray, np.ndarray]:
    """Offsets at which a word starts, and the number of tokens before each."""
    spans = np.array(encoding.offsets, dtype=np.int64).reshape(-1, 2)
    words = np.array([-1 if w is None else w for w in encoding.word_ids], dtype=np.int64)
    first = np.ones(len(words), dtype=bool)
    first[1:] = (words[1:] != words[:-1]) | (words[1:] < 0)
    at = np.flatnonzero(first)
    return spans[at, 0], at


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
    chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: the id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_windows.

    A missing text counts as empty (0 tokens).  A missing id stays missing; repeated rows and rows
    that share an id are counted each.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    long_text = F.length("text") > chunk_chars + overlap_chars
    short = _short(rows.where(~long_text), tokenizer_path, kind)
    parts = [short, *_spliced(rows.where(long_text), tokenizer_path, kind, chunk_chars, overlap_chars)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_windows")


def _short(rows: DataFrame, path: str, kind: str) -> DataFrame:
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = load(path)
        texts = batch.column("text").to_pylist()
        known = kept_in_worker("token_parts")
        if path not in known:
            known[path] = {} if splits_at_spaces(tokenizer) else None
        counts = counted(tokenizer, texts) if known[path] is None else counted_by_part(tokenizer, texts, known[path])
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    sized = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return over_batches(sized, count, f"id {kind}, n_bytes long, n_tokens long").withColumn("n_windows", F.lit(1).cast("long"))


def _spliced(rows: DataFrame, path: str, kind: str, chunk: int, overlap: int) -> list[DataFrame]:
    """Results of the long texts, a frame per width that was needed."""
    keyed = rows.withColumn("digest", F.sha2("text", 256))
    done: list[DataFrame] = []
    todo = keyed
    while True:
        found = stored(_measure(todo, path, kind, chunk, overlap), "windows")
        done.append(found.where("n_open = 0").withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("id", "n_bytes", "n_tokens", "n_windows"))
        failed = found.where("n_open > 0")
        if failed.isEmpty():
            return done
        again = failed.select(F.col("id").alias("id2"), F.col("digest").alias("digest2"))
        todo = keyed.join(again, F.col("id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")), "left_semi")
        chunk, overlap = chunk * WIDEN, overlap * WIDEN


def _measure(rows: DataFrame, path: str, kind: str, chunk: int, overlap: int) -> DataFrame:
    """Per distinct (id, text): token count, number of seams without a splice point, row count."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                text = one.column("text")[0].as_py()
                starts = list(range(0, max(1, len(text) - overlap), chunk))
                for k in range(0, len(starts), 64):
                    part = starts[k : k + 64]
                    take = pa.array([0] * len(part))
                    last = [s == starts[-1] for s in part]
                    piece = [text[s:] if z else text[s : s + chunk + overlap] for s, z in zip(part, last, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [*(one.column(c).take(take) for c in ("id", "digest", "n_bytes")), pa.array(part, pa.int64()), pa.array(last), pa.array(piece, pa.string())],
                        ["id", "digest", "n_bytes", "start", "is_last", "piece"],
                    )

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = load(path)
        keep = margin(tokenizer)
        texts, starts, lasts = (batch.column(c).to_pylist() for c in ("piece", "start", "is_last"))
        total, left, left_n, right, right_n = [], [], [], [], []
        for part in runs_of_text([len(t) for t in texts], CALL_CHARS):
            for e, text, s, z in zip(tokenizer.encode_batch(texts[part], add_special_tokens=False), texts[part], starts[part], lasts[part], strict=True):
                at, n = word_bounds(e)
                at, n = np.append(at, len(text)), np.append(n, len(e))  # the end is a boundary too
                stop = len(text) if z else len(text) - keep
                near = (at <= min(overlap, stop)) & (s > 0)
                far = (at >= chunk) & (at <= stop) & (not z)
                total.append(len(e))
                left.append(at[near] + s)
                left_n.append(n[near])
                right.append(at[far] + s)
                right_n.append(n[far])
        lists = [pa.array(x, pa.list_(pa.int64())) for x in (left, left_n, right, right_n)]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("id", "digest", "n_bytes", "start", "is_last")), pa.array(total, pa.int64()), *lists],
            ["id", "digest", "n_bytes", "start", "is_last", "total", "left", "left_n", "right", "right_n"],
        )

    base = f"id {kind}, digest string, n_bytes long, start long, is_last boolean"
    pieces = rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(cut, f"{base}, piece string")
    spread = pieces.repartition("id", "digest", "start")  # the windows of one text go to many tasks
    lists = "left array<long>, left_n array<long>, right array<long>, right_n array<long>"
    coded = over_batches(spread, encode, f"{base}, total long, {lists}")
    # repeated rows give equal windows: keep one of each and the number of copies
    names = ["n_bytes", "is_last", "total", "left", "left_n", "right", "right_n"]
    single = coded.groupBy("id", "digest", "start").agg(F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in names])
    w = Window.partitionBy("id", "digest").orderBy("start")
    seam = F.array_min(F.array_intersect("right", F.lead("left").over(w)))
    at = lambda pos, n, p: F.element_at(F.col(n), F.array_position(F.col(pos), p).cast("int"))
    cutpoints = single.withColumn("to", seam).withColumn("from", F.lag("to").over(w))
    open_seam = ~F.col("is_last") & F.col("to").isNull()
    ends = F.when(F.col("is_last"), F.col("total")).when(F.col("to").isNotNull(), at("right", "right_n", F.col("to")))
    begins = F.when(F.col("start") == 0, F.lit(0)).when(F.col("from").isNotNull(), at("left", "left_n", F.col("from")))
    return cutpoints.groupBy("id", "digest").agg(
        F.first("n_bytes").alias("n_bytes"), F.sum(ends - begins).alias("n_tokens"), F.count(F.when(open_seam, 1)).alias("n_open"),
        F.count(F.lit(1)).alias("n_windows"), F.max("copies").alias("copies"),
    )
