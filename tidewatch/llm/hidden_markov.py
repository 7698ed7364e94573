"""Hidden Markov language model: Baum-Welch over all training texts, exact forward scores.

The states emit word classes: the ``OWN`` most frequent words and the end of a text have a class of
their own, every other word, known or not, belongs to one of ``ENDINGS`` classes by its last bytes.
Inside a class a word has the share (c + 0.1) / (N_class + 0.1 (V_class + 1)), unknown words the
share of c = 0, so that

    P(text) = P(classes | states, transitions) * product of P(word | class).

Transitions and class emissions are ``STATES`` x (``STATES`` + ``OWN`` + ``ENDINGS`` + 1) numbers
whatever the corpus; each Baum-Welch round sums expected counts per task, then across tasks, and
only those sums reach the driver.  Rounds over all training texts go on until the likelihood of a token
rises by less than ``TOLERANCE``; they start from a model of about ``START_BYTES`` of the texts, which
took up to ``START_ROUNDS`` rounds of its own (all counts of the result come from all texts).  Word counts have no such bound: they stay in a table, and the
counts that a batch of texts needs are sent to it by a join (a batch counts its own training words,
so only words that also occur elsewhere are sent).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import over_batches, stored, text_of
from tidewatch.llm.words import Words, in_slices

STATES = 6
OWN = 768
ENDINGS = 512
#: A rise of the log10 likelihood per token that ends the rounds, and the most rounds over all texts.
TOLERANCE = 0.001
MOST_ROUNDS = 50
#: Training texts (chosen by hash) from which the rounds start, and the rounds there.
START_BYTES = 4_000_000
START_ROUNDS = 30
#: Text that one scoring batch holds.
BATCH_BYTES = 8_000_000
#: Tokens whose forward and backward values are held at once.
HELD_TOKENS = 250_000
#: Forward and backward values are scaled every few steps, and at once where a sum falls below LEAST.
SCALE_STEPS = 6
LEAST = 1e-60
END = b""  # no word is empty
ADD = 0.1


def with_ends(words: Words) -> Words:
    """Every text closed by the code of ``END``, the last of the word list."""
    n = len(words.starts) - 1
    starts = words.starts + np.arange(n + 1)
    codes = np.full(starts[-1], len(words.words), dtype=np.int32)
    inner = np.ones(len(codes), dtype=bool)
    inner[starts[1:] - 1] = False
    codes[inner] = words.codes
    return Words(codes, starts, pa.concat_arrays([words.words, pa.array([END], pa.large_binary())]))


def tokenized(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[pa.RecordBatch | pa.Table, Words]]:
    for piece, words in in_slices(batch):
        yield piece, with_ends(words)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is divisible by 10 (a missing id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def endings(words: pa.Array, n: int) -> np.ndarray:
    """A number below ``n`` from the last three bytes of each word (fewer where it is shorter)."""
    words = pa.concat_arrays([words.take(pa.array(np.arange(len(words)))).cast(pa.large_binary()), pa.array([b"   "], pa.large_binary())])
    at = np.frombuffer(words.buffers()[1], dtype=np.int64)[: len(words) + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
    mixed = np.zeros(len(words) - 1, dtype=np.uint64)
    for back in (1, 2, 3):
        place = at[1:-1] - back
        mixed = mixed * np.uint64(257) + np.where(place >= at[:-2], data[np.maximum(place, 0)], 0).astype(np.uint64) + np.uint64(1)
    return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n


@dataclass
class Classes:
    """Class of a word: its own, or that of its ending."""

    own: list[bytes]
    n_own: int
    n_endings: int

    @property
    def size(self) -> int:
        return self.n_own + self.n_endings + 1

    def of(self, words: pa.Array) -> np.ndarray:
        """Class of each word; the empty word is the end."""
        place = pc.index_in(words, value_set=pa.array(self.own, words.type)).fill_null(-1).to_numpy()
        out = np.where(place >= 0, place, self.n_own + endings(words, self.n_endings))
        return np.where(pc.binary_length(words).to_numpy() == 0, self.size - 1, out).astype(np.int32)

    def sequences(self, tokens: Words) -> list[np.ndarray]:
        seen = self.of(tokens.words)[tokens.codes]
        return [seen[tokens.text(i)] for i in range(len(tokens.starts) - 1)]


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x classes


def first_model(class_share: np.ndarray, states: int, seed: int = 7) -> Model:
    """States that tend to stay, with emissions around the shares of the classes."""
    rng = np.random.default_rng(seed)
    emit = class_share * rng.gamma(1.0, 1.0, (states, len(class_share)))
    move = np.full((states, states), 0.1 / max(1, states - 1)) + (0.9 - 0.1 / max(1, states - 1)) * np.eye(states)
    return Model(np.full(states, 1.0 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def grouped(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Indices of sequences of similar length, ``HELD_TOKENS`` together (a longer one stands alone)."""
    group: list[int] = []
    size = 0
    for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
        if group and size + len(sequences[i]) > HELD_TOKENS:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(sequences[i])
    if group:
        yield group


class Lattice:
    """Forward and backward values of sequences sorted by falling length, step after step.

    Row ``offsets[t] + i`` belongs to step t of sequence i; step t has the ``alive[t]`` sequences
    longer than t.  Emissions are divided by their largest over the states, forward and backward
    values by their sums at every ``SCALE_STEPS``-th step, and wherever one falls below ``LEAST``;
    the logarithms of both are kept.
    """

    def __init__(self, sequences: list[np.ndarray], model: Model):
        self.start, self.move, self.size = model.start, model.move, model.emit.shape[1]
        lengths = np.array([len(s) for s in sequences])
        self.alive = len(lengths) - np.searchsorted(lengths[::-1], np.arange(lengths[0]), side="right")
        self.offsets = np.concatenate([[0], np.cumsum(self.alive)])
        flat = np.concatenate(sequences)
        self.ends = np.cumsum(lengths)
        step = np.concatenate([np.arange(n) for n in lengths])
        self.rows = self.offsets[step] + np.repeat(np.arange(len(lengths)), lengths)
        self.sequence = np.empty(len(flat), dtype=np.int64)
        self.sequence[self.rows] = np.repeat(np.arange(len(lengths)), lengths)
        self.seen = np.empty(len(flat), dtype=np.int64)
        self.seen[self.rows] = flat
        top = model.emit.max(axis=0)
        self.e = np.ascontiguousarray((model.emit / top).T)[self.seen]
        self.log = np.bincount(self.sequence, np.log10(top)[self.seen], len(lengths))

    def forward(self) -> np.ndarray:
        """Log10 likelihood of each sequence; fills ``a``."""
        self.a = np.empty_like(self.e)
        off, alive, move, e, a = self.offsets.tolist(), self.alive.tolist(), self.move, self.e, self.a
        np.multiply(e[: alive[0]], self.start, out=a[: alive[0]])
        ones = np.ones(e.shape[1])
        for t in range(1, len(alive)):
            n, now, last = alive[t], off[t], off[t - 1]
            here = a[now : now + n]
            np.dot(a[last : last + n], move, out=here)
            here *= e[now : now + n]
            total = here @ ones
            if t % SCALE_STEPS == 0 or total.min() < LEAST:
                here /= total[:, None]
                self.log[:n] += np.log10(total)
        at_end = self.rows[self.ends - 1]
        self.log[self.sequence[at_end]] += np.log10(a[at_end].sum(axis=1))
        return self.log

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions."""
        off, alive, e, a = self.offsets, self.alive, self.e, self.a
        back = np.ascontiguousarray(self.move.T)
        b = np.ones_like(e)
        ones = np.ones(e.shape[1])
        n_alive, at = alive.tolist(), off.tolist()
        for t in range(len(alive) - 2, -1, -1):
            n, now, after = n_alive[t + 1], at[t], at[t + 1]
            here = b[now : now + n]
            np.dot(e[after : after + n] * b[after : after + n], back, out=here)
            total = here @ ones
            if t % SCALE_STEPS == 0 or total.min() < LEAST:
                here /= total[:, None]
        later = (e * b)[off[1] :]
        earlier = a[np.arange(off[1], off[-1]) - np.repeat(alive[:-1], alive[1:])]
        later /= np.einsum("ij,ij->i", earlier @ self.move, later)[:, None]
        moves = self.move * (earlier.T @ later)
        b *= a
        b /= (b @ ones)[:, None]
        emits = np.stack([np.bincount(self.seen, column, self.size) for column in np.ascontiguousarray(b.T)])
        return b[: alive[0]].sum(axis=0), moves, emits


def likelihoods(sequences: list[np.ndarray], model: Model) -> np.ndarray:
    out = np.zeros(len(sequences))
    for group in grouped(sequences):
        out[group] = Lattice([sequences[i] for i in group], model).forward()
    return out


def re_estimate(rows: DataFrame, model: Model, classes: Classes, class_share: np.ndarray) -> tuple[Model, float]:
    """One Baum-Welch round over ``rows`` (text); also the log10 likelihood before it."""
    k, size = model.emit.shape

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + k + k * k + k * size)
        for batch in batches:
            for _, tokens in tokenized(batch):
                sequences = classes.sequences(tokens)
                for group in grouped(sequences):
                    lattice = Lattice([sequences[i] for i in group], model)
                    total[0] += lattice.forward().sum()
                    total[1:] += np.concatenate([x.ravel() for x in lattice.counts()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["at", "n"])

    sums = rows.select("text").mapInArrow(expect, "at int, n double").groupBy("at").agg(F.sum("n").alias("n"))
    total = np.zeros(1 + k + k * k + k * size)
    for at, n in sums.toPandas().itertuples(index=False):  # as many rows as the model has numbers
        total[int(at)] = n
    start, move, emit = np.split(total[1:], [k, k + k * k])
    start, move = start + 1.0 / k, move.reshape(k, k) + 1.0 / k
    emit = emit.reshape(k, size) + 10.0 * class_share
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)), float(total[0])


@dataclass
class Fitted:
    model: Model
    classes: Classes
    class_words: np.ndarray  # training tokens of each hashed class
    class_kinds: np.ndarray  # distinct training words of each hashed class
    tokens: int
    kinds: int


def batch_words(rows: DataFrame) -> DataFrame:
    """(word, batch, n): each word of each batch, with its training tokens there."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        for batch in batches:
            for piece, tokens in tokenized(batch):
                sizes, size = np.diff(tokens.starts), len(tokens.words)
                key = np.repeat(piece.column("batch").to_numpy().astype(np.int64) * size, sizes) + tokens.codes
                trains = np.repeat(~piece.column("held_out").to_numpy(zero_copy_only=False), sizes)
                pairs, at = np.unique(key, return_inverse=True)
                n = np.bincount(at, trains, len(pairs))
                cuts = np.flatnonzero(np.append(True, pairs[1:] // size != pairs[:-1] // size)) if len(pairs) else []
                for lo, hi in zip(cuts, [*cuts[1:], len(pairs)], strict=True):
                    found.setdefault(int(pairs[lo] // size), []).append((tokens.words.take(pa.array(pairs[lo:hi] % size)), n[lo:hi]))
        for where, parts in found.items():
            coded = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), np.concatenate([n for _, n in parts]), len(coded.dictionary)).astype(np.int64)
            for lo in range(0, len(n), 50_000):
                some = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([coded.dictionary[some].cast(pa.binary()), pa.array(np.full(len(n[some]), where, np.int32)), pa.array(n[some])], ["word", "batch", "n"])

    # texts of a batch come to one task, so that each of its words is one row
    return rows.select("text", "batch", "held_out").repartition("batch").mapInArrow(count, "word binary, batch int, n long")


def until_flat(rows: DataFrame, model: Model, classes: Classes, share: np.ndarray, tokens: int, tolerance: float, most: int) -> Model:
    """Baum-Welch rounds until the log10 likelihood per token rises by less than ``tolerance``."""
    before = None
    for _ in range(most):
        model, likelihood = re_estimate(rows, model, classes, share)
        if before is not None and likelihood - before < tolerance * max(tokens, 1):
            break
        before = likelihood
    return model


def start_sample(rows: DataFrame, size: int, most: int) -> tuple[DataFrame, int]:
    """About ``most`` bytes of the texts (longer ones than that left out), written once, and their tokens."""
    share = min(1.0, most / max(size, 1))
    some = rows.where((F.octet_length("text") <= most) & (F.pmod(F.xxhash64(F.lit("start"), "text"), F.lit(1_000_000)) < int(share * 1_000_000)))
    some = stored(some.repartition(max(1, rows.sparkSession.sparkContext.defaultParallelism), F.xxhash64("text")), "start")
    words = F.size(F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    return some, int(some.agg(F.sum(words + 1).alias("n")).first().n or 0)


def fit(
    rows: DataFrame, counts: DataFrame, states: int = STATES, rounds: int | None = None, n_own: int = OWN, n_endings: int = ENDINGS,
    tolerance: float = TOLERANCE, start_bytes: int = START_BYTES, size: int = 0,
) -> Fitted:
    """Train on ``rows`` (text, ``size`` bytes) with ``counts`` (word, c), one row per training word.
    ``rounds``: exactly as many from the first model, instead of until the likelihood is flat."""
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("c"), "word").limit(n_own).collect()  # at most n_own rows
    classes = Classes([bytes(r.word) for r in top], n_own, n_endings)

    def by_class(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = classes.of(batch.column("word"))
        sums = np.bincount(of, batch.column("c").to_numpy(), classes.size), np.bincount(of, minlength=classes.size)
        at = np.flatnonzero(sums[1])
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[0][at]), pa.array(sums[1][at], pa.int64())], ["at", "n", "v"])

    sums_of = np.zeros((2, classes.size))
    for r in over_batches(counts, by_class, "at int, n double, v long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # as many rows as classes
        sums_of[:, r["at"]] = r.n, r.v
    words, kinds = (x[n_own : n_own + n_endings] for x in sums_of)
    share = sums_of[0] + ADD
    share /= share.sum()
    model = first_model(share, states)
    if rounds is None and sums.n:
        some, tokens = start_sample(rows, size, start_bytes)
        model = until_flat(some, model, classes, share, tokens, tolerance, START_ROUNDS) if tokens else model
        model = until_flat(rows, model, classes, share, int(sums.n), tolerance, MOST_ROUNDS)
    for _ in range(rounds or 0):
        model, _ = re_estimate(rows, model, classes, share)
    return Fitted(model, classes, words, kinds, int(sums.n or 0), int(sums.v or 0))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES, **settings: float) -> DataFrame:
    """One row per row of ``docs``: the id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10 probability under the model trained on the rows that are not held out).

    A missing text counts as empty: one token, its end.  Repeated rows are counted and scored each;
    a missing id is held out.  Without training rows every word is unknown and the model stays at
    its first values.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), held_out(id_col).alias("held_out"))
    kind = rows.schema["id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(int(size // batch_bytes) + 1)).cast("int"))
    by_word = Window.partitionBy("word")
    placed = stored(
        batch_words(rows).withColumn("c", F.sum("n").over(by_word)).withColumn("r", F.row_number().over(by_word.orderBy("batch"))).withColumn("parts", F.count(F.lit(1)).over(by_word)), "words"
    )
    counts = placed.where("r = 1 AND c > 0").select("word", "c")
    fitted = fit(rows.where(~F.col("held_out")).select("text"), counts, size=int(size), **settings)
    # a word that came in one part is counted by the batch itself
    sent = placed.where("parts > 1").select("word", "batch", "c")
    return scored(rows, sent, fitted, kind).withColumnRenamed("id", id_col)


def scored(rows: DataFrame, sent: DataFrame, fitted: Fitted, kind: str) -> DataFrame:
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    classes = fitted.classes
    base_all = np.log10(fitted.tokens + ADD * (fitted.kinds + 1))
    in_class = np.log10(fitted.class_words + ADD * (fitted.class_kinds + 1))

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        sent_words = words.column("word").combine_chunks().cast(pa.large_binary())
        sent_counts = words.column("c").to_numpy()
        pieces = list(tokenized(texts))
        # training words of this batch that were not sent: they occur nowhere else
        kinds, n = [], []
        for piece, tokens in pieces:
            trains = np.repeat(~piece.column("held_out").to_numpy(), np.diff(tokens.starts))
            kinds.append(tokens.words)
            n.append(np.bincount(tokens.codes, trains, len(tokens.words)))
        coded = pa.concat_arrays(kinds).dictionary_encode()
        mine = np.bincount(coded.indices.to_numpy(), np.concatenate(n))
        place = pc.index_in(coded.dictionary, value_set=sent_words).fill_null(-1).to_numpy()
        count = np.where(place >= 0, sent_counts[place] if len(sent_counts) else 0, mine)
        of_piece = np.split(count[coded.indices.to_numpy()], np.cumsum([len(k) for k in kinds])[:-1])
        out = []
        for (piece, tokens), c in zip(pieces, of_piece, strict=True):
            class_of = classes.of(tokens.words)
            logs = np.log10(c + ADD)
            h = class_of - classes.n_own
            hashed = (h >= 0) & (h < classes.n_endings)
            inner = np.where(hashed, logs - in_class[np.where(hashed, h, 0)], 0.0)
            starts = tokens.starts[:-1]
            n_tokens = np.diff(tokens.starts)
            sums = [np.add.reduceat(x[tokens.codes], starts) for x in ((c > 0).astype(np.int64), logs, inner)]
            score = likelihoods(classes.sequences(tokens), fitted.model) + sums[2]
            full = np.full(len(starts), fitted.tokens, dtype=np.int64)
            columns = [n_tokens.astype(np.int64), sums[0], full, sums[1] - n_tokens * base_all, score]
            names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
            out.append(pa.table({"id": piece.column("id"), "held_out": piece.column("held_out"), **dict(zip(names, columns, strict=True))}))
        return pa.concat_tables(out) if out else None

    empty = rows.sparkSession.createDataFrame([], schema).toArrow()

    def group(texts: pa.Table, words: pa.Table) -> pa.Table:
        found = run(texts.select(["id", "text", "held_out"]), words) if texts.num_rows else None
        return found if found is not None else empty

    return rows.groupBy("batch").cogroup(sent.groupBy("batch")).applyInArrow(group, schema)

