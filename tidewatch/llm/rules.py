"""Quality rules as a learned decision list over document statistics.

``statistics`` counts words, symbols, repeated lines and repeated three-word windows of whole texts.
``learn`` fits a list of threshold conjunctions to labelled rows by sequential covering: a rule for
poor documents is grown on two thirds of the rows, one condition at a time by information gain, cut
back on the other third to its best prefix, kept if it is precise enough there, and the rows it
covers are taken out before the next one.  ``verdict`` turns the list into an ordered Spark conditional expression, so the
corpus is judged without Python.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import over_batches, text_of

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: Labelled rows that a list is fitted to; the rows with the smallest hashes where there are more.
FIT_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
#: Share of truly poor documents that a rule must reach on the rows it was not grown on.
PRECISION = 0.95
#: Poor documents a rule must cover on each side.
SUPPORT = 4

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_kinds", "n_digits", "n_upper", "n_long_words", "n_marks", "n_bytes")


def document_counts(data: bytes) -> tuple[int, ...]:
    words = data.split()  # bytes split at exactly the six ASCII space characters
    bare = data.translate(None, SPACES)
    lines = [line for line in data.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    n_repeat = 0
    if len(windows) > len(set(windows)):
        times = Counter(windows)
        covered = bytearray(len(words))
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered[i : i + 3] = b"\1\1\1"
        n_repeat = covered.count(1)
    return (
        len(words), _points(bare), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), n_repeat, len(lines), len(set(words)),
        len(data) - len(data.translate(None, b"0123456789")), len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        sum(n > 20 for n in map(len, words)), len(data) - len(data.translate(None, b".,;:!?")), len(data),
    )


#: Bytes that go on a character of several bytes.
_TAIL = bytes(range(0x80, 0xC0))


def _points(data: bytes) -> int:
    return len(data.translate(None, _TAIL))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the counts of ``COUNTS`` and base_failed.

    A missing text has no words (and so fails the base rules); missing ids and repeated rows are
    kept.  Other columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        counts = np.array([document_counts(t) for t in texts], dtype=np.int64).reshape(len(texts), len(COUNTS))
        return pa.table({"id": batch.column("id"), **{c: counts[:, i] for i, c in enumerate(COUNTS)}})

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = over_batches(rows, run, f"id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.withColumn("base_failed", base_failed()).withColumnRenamed("id", id_col)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def features() -> dict[str, Column]:
    """What the rules test: sizes and shares, 0 where there is nothing to divide by."""

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "repeated_lines": share("n_dup_lines", "n_lines"),
        "repeated_words": share("n_repeat_words", "n_words"),
        "words_per_line": share("n_words", "n_lines"),
        "kinds_per_word": share("n_kinds", "n_words"),
        "digits_per_char": share("n_digits", "word_chars"),
        "capitals_per_word": share("n_upper", "n_words"),
        "long_words": share("n_long_words", "n_words"),
        "marks_per_word": share("n_marks", "n_words"),
        "bytes_per_char": share("n_bytes", "word_chars"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        return values > self.threshold if self.above else values <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > F.lit(self.threshold) if self.above else of[self.feature] <= F.lit(self.threshold)


#: A rule: all its conditions hold.  A list: the first rule that holds rejects.
Rule = tuple[Condition, ...]


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """Features and label of at most ``rows`` labelled documents, those with the smallest hashes.
    Missing ids and labels are left out; an id with several labels counts as poor if any is 0."""
    single = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    some = single.orderBy(F.xxhash64(F.lit("fit"), "_id"), "_id").limit(rows)  # bounded, so it may be broadcast
    mine = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col)).join(F.broadcast(some), F.col(id_col) == F.col("_id")).select(id_col, text_col)
    counted = statistics(mine, id_col, text_col)
    return counted.where(~F.col("base_failed")).join(F.broadcast(some), F.col(id_col) == F.col("_id")).select(
        F.col(id_col).cast("string").alias("id"), (F.col("_label") == 0).alias("poor"), *[c.alias(n) for n, c in features().items()]
    )


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> list[Rule]:
    """The decision list; empty without labelled rows, or where no rule is precise enough."""
    found = labelled_rows(docs, labels, id_col, text_col, label_col, rows).orderBy(F.xxhash64("id"), "id").toPandas()
    names = list(features())
    return cover(found[names].to_numpy(dtype=np.float64), found["poor"].to_numpy(dtype=bool), names)


def cover(values: np.ndarray, poor: np.ndarray, names: list[str]) -> list[Rule]:
    """Sequential covering; every third row is held back for pruning."""
    left = np.ones(len(poor), dtype=bool)
    held = np.arange(len(poor)) % 3 == 2
    out: list[Rule] = []
    while len(out) < MAX_RULES:
        grow, test = left & ~held, left & held
        rule = _grow(values[grow], poor[grow], names)
        rule = _prune(rule, values[test], poor[test], names)
        if not rule:
            break
        hit = _covered(rule, values, names)
        if (hit & grow & poor).sum() < SUPPORT or (hit & left & poor).sum() < PRECISION * (hit & left).sum():
            break
        out.append(rule)
        left &= ~hit
    return out


def _covered(rule: Rule, values: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(values), dtype=bool)
    for c in rule:
        hit &= c.holds(values[:, names.index(c.feature)])
    return hit


def _grow(values: np.ndarray, poor: np.ndarray, names: list[str]) -> Rule:
    """Add the condition with the most information gain until the rule covers poor rows only."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and poor.any() and not poor.all():
        best = max((_best(values[:, j], poor, n) for j, n in enumerate(names)), key=lambda b: b[0])
        if best[0] <= 0:
            break
        hit = best[1].holds(values[:, names.index(best[1].feature)])
        rule.append(best[1])
        values, poor = values[hit], poor[hit]
    return tuple(rule)


def _best(x: np.ndarray, poor: np.ndarray, name: str) -> tuple[float, Condition]:
    """The threshold of one feature with the highest gain p * (log p/t - log P/T)."""
    order = np.argsort(x, kind="stable")
    v, y = x[order], poor[order]
    cut = np.flatnonzero(v[1:] > v[:-1])
    nothing = (0.0, Condition(name, True, 0.0))
    if not len(cut):
        return nothing
    p_low, n_low = np.cumsum(y)[cut], cut + 1.0
    p_all, n_all = float(y.sum()), float(len(y))
    best = nothing
    for above, p, n in ((False, p_low, n_low), (True, p_all - p_low, n_all - n_low)):
        gain = np.where(p >= SUPPORT, p * (np.log2(np.maximum(p, 1) / n) - np.log2(p_all / n_all)), 0.0)
        i = int(np.argmax(gain))
        if gain[i] > best[0] + 1e-12:
            best = (float(gain[i]), Condition(name, above, float((v[cut[i]] + v[cut[i] + 1]) / 2)))
    return best


def _prune(rule: Rule, values: np.ndarray, poor: np.ndarray, names: list[str]) -> Rule:
    """The prefix that is best on held-back rows, by (p - n) / (p + n), the shorter one at a tie;
    nothing if none is precise and supported there."""
    best: tuple[float, Rule] = (0.0, ())
    for k in range(1, len(rule) + 1):
        hit = _covered(rule[:k], values, names)
        p, t = int((hit & poor).sum()), int(hit.sum())
        if p >= min(SUPPORT, 2) and p >= PRECISION * t and (2 * p - t) / t > best[0]:
            best = ((2 * p - t) / t, rule[:k])
    return best[1]


def rule_columns(rules: list[Rule]) -> list[Column]:
    of = features()
    out = []
    for rule in rules:
        hit = rule[0].column(of)
        for c in rule[1:]:
            hit = hit & c.column(of)
        out.append(hit)
    return out


def verdict(rules: list[Rule]) -> Column:
    """1, 2, ... for the first rule that rejects, 0 where none does."""
    out = None
    for i, hit in enumerate(rule_columns(rules), 1):
        out = F.when(hit, F.lit(i)) if out is None else out.when(hit, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Statistics with base_failed, rule (the rejecting rule, 0 for none) and kept."""
    rules = learn(docs, labels, id_col, text_col, rows=fit_rows)
    return statistics(docs, id_col, text_col).withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns and nothing shuffled.

    The counts travel beside the row as one struct named like no column of ``docs``."""
    rules = learn(docs, labels, id_col, text_col, rows=fit_rows)
    beside = "_counts"
    while beside in docs.columns:
        beside += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(beside, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).cast(pa.binary()).to_pylist()
        counts = np.array([document_counts(t or b"") for t in texts], dtype=np.int64).reshape(len(texts), len(COUNTS))
        struct = pa.StructArray.from_arrays([pa.array(counts[:, i]) for i in range(len(COUNTS))], names=list(COUNTS))
        return pa.RecordBatch.from_arrays([*batch.columns, struct], [*batch.schema.names, beside])

    counted = over_batches(docs, run, schema)
    # judge the struct's fields under their own names, then drop them again
    flat = counted.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), f"{beside}.*")
    return flat.where(~base_failed() & (verdict(rules) == 0)).select("_row.*")
