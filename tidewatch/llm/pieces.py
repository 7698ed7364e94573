"""SentencePiece BPE in vectorised merge rounds, and its decoding.

The symbols of many words lie in one flat array.  A round looks up the rank of every neighbouring
pair, takes the smallest rank of each word (a segmented minimum), merges all its occurrences at
once, leftmost first where they overlap, and compacts the array; words without a pair leave it.

Merging all occurrences at once equals merging them one after the other as long as no merge creates
a pair of a smaller or equal rank beside it.  That is checked for every occurrence with the symbols
it would meet; a word keeps the occurrences up to the first that fails, and goes on in the next round.
Words still unfinished after ``ROUNDS`` rounds (long runs of one character) take the usual agenda.

Words are cut where no piece can reach across: before a space mark that follows another character
and around characters that are in no piece longer than themselves, such as line breaks.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import kept_in_worker, over_batches, runs_of_text, text_of

SPACE = "▁"
ROUNDS = 256
#: Characters of distinct words merged together.
BATCH_CHARS = 300_000
#: Distinct words remembered by a Python worker.
KNOWN_WORDS = 500_000
NONE = np.iinfo(np.int32).max
#: Slots of the pair table; at least twice the pairs of the model.
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS


class PieceModel:
    """Pieces, scores and flags of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n = m.normalizer_spec
        plain = n.add_dummy_prefix and n.escape_whitespaces and not n.remove_extra_whitespaces and not n.precompiled_charsmap
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or not plain or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this model needs more than BPE with byte fallback on escaped text")
        kinds = [p.type for p in m.pieces]  # 1 normal, 2 unknown, 3 control, 6 byte
        if set(kinds) - {1, 2, 3, 6}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.pieces = [p.piece for p in m.pieces]
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes across words")
        self.byte_id = np.zeros(256, dtype=np.int64)
        for i, k in enumerate(kinds):
            if k == 6:
                self.byte_id[int(self.pieces[i][1:-1], 16)] = i
        order = {s: r for r, s in enumerate(sorted({-m.pieces[i].score for i in self.ids.values()}))}
        self.size = len(self.pieces)
        keys, made, ranks = [], [], []
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                left, right = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    made.append(i)
                    ranks.append(order[-m.pieces[i].score])
        at = np.argsort(keys)
        self.keys = np.array(keys, dtype=np.int64)[at]
        self.made = np.array(made, dtype=np.int32)[at]
        self.rank = np.array(ranks, dtype=np.int32)[at]
        self.slots, self.slot_place = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SLOTS, dtype=np.int64)
        if 2 * len(self.keys) > SLOTS:
            raise ValueError("too many pairs for the hash table")
        for i, s in enumerate(self._slot(self.keys).tolist()):
            while self.slots[s] >= 0:
                s = (s + 1) & (SLOTS - 1)
            self.slots[s], self.slot_place[s] = self.keys[i], i
        self.pair = {k: (r, i) for k, r, i in zip(self.keys.tolist(), self.rank.tolist(), self.made.tolist(), strict=True)}
        # single characters by code point; others keep -1 and fall back to bytes
        self.char_id = np.full(0x110000, -1, dtype=np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids if len(p) > 1))
        self.words = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        out = [p.replace(SPACE, " ").encode() if k == 1 else b" \xe2\x81\x87 " if k == 2 else b"" if k == 3 else bytes([int(p[1:-1], 16)]) for p, k in zip(self.pieces, kinds, strict=True)]
        self.id_text = [str(i) for i in range(self.size)]
        self.is_byte = np.array([k == 6 for k in kinds])
        self.skipped = np.array([k == 3 for k in kinds])
        self.out_len = np.array([len(b) for b in out], dtype=np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)

    def split(self, text: str) -> list[str]:
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE without one) and the piece it makes; a probed hash table."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -2
        slot = self._slot(key)
        held = self.slots[slot]
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
            held = self.slots[slot[todo]]
            todo = todo[(held != key[todo]) & (held >= 0)]
        place = self.slot_place[slot]
        hit = self.slots[slot] == key
        return np.where(hit, self.rank[place], NONE), self.made[place]

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (words as ``split`` gives them), int32 as bytes."""
        out = [b""] * len(words)
        chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        sym = self.char_id[chars]
        # a character without a piece stands as -1 - code point
        sym = np.where(sym < 0, -1 - chars, sym).astype(np.int32)
        rounds = 0
        while len(sym):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            rank, made = np.full(len(sym), NONE, dtype=np.int32), np.zeros(len(sym), dtype=np.int32)
            rank[:-1], made[:-1] = self.look_up(sym[:-1], sym[1:])
            rank[np.append(starts[1:], len(sym)) - 1] = NONE  # the last symbol of a word
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            ended = low == NONE
            if rounds >= ROUNDS:
                for s, n in zip(starts[~ended].tolist(), sizes[~ended].tolist(), strict=True):
                    out[word[s]] = self._final(np.array(self._agenda(sym[s : s + n].tolist()), dtype=np.int32))
            if ended.any():
                data = sym.tobytes()
                bare = np.minimum.reduceat(sym, starts) < 0
                for w, s, n, x in zip(word[starts[ended]].tolist(), starts[ended].tolist(), sizes[ended].tolist(), bare[ended].tolist(), strict=True):
                    out[w] = self._final(sym[s : s + n]) if x else data[4 * s : 4 * (s + n)]
                stay = np.repeat(~ended, sizes)
                sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
                low, sizes = low[~ended], sizes[~ended]
            if rounds >= ROUNDS or not len(sym):
                break
            sym, word = self._merge(sym, word, rank, made, np.repeat(low, sizes))
            rounds += 1
        return out

    def _merge(self, sym, word, rank, made, low):
        at = np.flatnonzero(rank == low)
        # overlapping occurrences (one follows the other directly): every second from the left
        run = np.append(True, (at[1:] != at[:-1] + 1))
        first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
        new, r = made[at], rank[at]
        # what the merged symbol meets at its left (already merged, where chosen) and at its right
        n = len(sym)
        has_left = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
        left = sym[np.maximum(at - 1, 0)]
        follows = np.append(False, (at[1:] == at[:-1] + 2) & (word[at[1:]] == word[at[:-1]]))
        left = np.where(follows, np.append(0, new[:-1]), left)
        beyond = np.minimum(at + 2, n - 1)
        has_right = (at + 2 < n) & (word[beyond] == word[at])
        worse = np.zeros(len(at), dtype=bool)
        worse[has_left] |= self.look_up(left[has_left], new[has_left])[0] <= r[has_left]
        worse[has_right] |= self.look_up(new[has_right], sym[beyond][has_right])[0] <= r[has_right]
        if worse.any():
            before = np.cumsum(worse) - worse
            opens = np.append(True, word[at[1:]] != word[at[:-1]])
            base = np.maximum.accumulate(np.where(opens, before, 0))
            keep = before == base
            at, new = at[keep], new[keep]
        sym = sym.copy()
        sym[at] = new
        stay = np.ones(n, dtype=bool)
        stay[at + 1] = False
        return sym[stay], word[stay]

    def _agenda(self, sym: list[int]) -> list[int]:
        """The usual agenda: smallest rank first, leftmost first among equals."""
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        alive: list[int | None] = list(sym)

        def offer(i: int) -> None:
            j = after[i] if 0 <= i < len(alive) else len(alive)
            if i >= 0 and j < len(alive) and alive[i] >= 0 and alive[j] >= 0 and (found := self.pair.get(alive[i] * self.size + alive[j])):
                heapq.heappush(heap, (found[0], i, alive[i], alive[j], found[1]))

        heap: list = []
        for i in range(len(sym) - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if alive[i] != a or j >= len(alive) or alive[j] != b:
                continue
            alive[i], alive[j] = new, None
            after[i] = after[j]
            if after[i] < len(alive):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [s for s in alive if s is not None]

    def _final(self, sym: np.ndarray) -> bytes:
        ids: list[int] = []
        for s in sym.tolist():
            ids += [s] if s >= 0 else self.byte_id[list(chr(-1 - s).encode())].tolist()
        return np.array(ids, dtype=np.int32).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: control pieces give nothing, runs of byte pieces their text, each
        invalid byte U+FFFD; the space that was put in front is taken away."""
        whole = not self.skipped[ids].any()
        shown = ids if whole else ids[~self.skipped[ids]]
        if not len(shown):
            return ""
        opens_with_space = not self.is_byte[shown[0]] and self.pieces[shown[0]].startswith(SPACE)
        data = self._bytes(shown)
        try:
            if whole:
                return data[opens_with_space:].decode()
        except UnicodeDecodeError:
            pass
        # bytes make a character only where they stand together
        cuts = [0, *(np.flatnonzero(self.is_byte[ids[1:]] != self.is_byte[ids[:-1]]) + 1).tolist(), len(ids)]
        parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return "".join(_with_replacements(self._bytes(p)) for p in parts)[opens_with_space:]

    def _bytes(self, ids: np.ndarray) -> bytes:
        size = self.out_len[ids]
        ends = np.cumsum(size)
        return self.out_bytes[np.repeat(self.out_at[ids] - (ends - size), size) + np.arange(ends[-1])].tobytes()


def _with_replacements(data: bytes) -> str:
    out, i = [], 0
    while i < len(data):
        lead = data[i]
        n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
        try:
            out.append(data[i : i + n].decode() if n else "�")
            i += n or 1
        except UnicodeDecodeError:
            out.append("�")
            i += 1
    return "".join(out)


def load(path: str) -> PieceModel:
    """The model, once per Python worker."""
    kept = kept_in_worker("piece_models")
    if path not in kept:
        kept[path] = PieceModel(path)
    return kept[path]


def encode_texts(model: PieceModel, texts: list[str], known: dict[str, bytes] | None = None) -> list[np.ndarray]:
    """The ids of each text.  ``known``: ids of words met before, as bytes of int32."""
    known = {} if known is None else known
    out = []
    for part in runs_of_text([len(t) for t in texts], 2_000_000):
        split = [model.split(t) for t in texts[part]]
        found = [list(map(known.get, words)) for words in split]
        new = list({w for words, got in zip(split, found, strict=True) if None in got for w, g in zip(words, got, strict=True) if g is None})
        fresh: dict[str, bytes] = {}
        for some in runs_of_text([len(w) for w in new], BATCH_CHARS):
            fresh.update(zip(new[some], model.encode_words(new[some]), strict=True))
        for words, got in zip(split, found, strict=True):
            joined = b"".join(fresh[w] if g is None else g for w, g in zip(words, got, strict=True)) if None in got else b"".join(got)
            out.append(np.frombuffer(joined, dtype=np.int32))
        if len(known) < KNOWN_WORDS:
            known.update(fresh)
    return out


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id and ``ids``, an array of ints (empty for a missing text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encode_texts(load(model_path), batch.column("text").to_pylist(), kept_in_worker("piece_words").setdefault(model_path, {}))
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return over_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``coded``: the id and ``text`` (empty for missing or no ids)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = load(model_path)
        texts = [model.decode(np.array(x if x is not None else [], dtype=np.int64)) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    rows = coded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return over_batches(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: the id, n_tokens, ids_sha256 (of the decimal ids joined by
    commas) and decoded_sha256 (of the decoded text in UTF-8), one row per row of ``docs``.

    A missing text counts as empty; missing ids, repeated rows and rows that share an id are kept.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        model, known = load(model_path), kept_in_worker("piece_words").setdefault(model_path, {})
        texts, counts, ids_sha, text_sha = batch.column("text").to_pylist(), [], [], []
        for part in runs_of_text([len(t) for t in texts], 2_000_000):
            for ids in encode_texts(model, texts[part], known):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(model.id_text.__getitem__, ids.tolist())).encode()).hexdigest())
                text_sha.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
        return pa.table({"id": batch.column("id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return over_batches(rows, run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
