"""Token counts and SentencePiece against the libraries."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tidewatch.llm import pieces, token_counts

JSON = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["a", "B", " ", "  ", "\n", "\t", "'re", "'", "9", "é", " ", "\x1c", "<|endoftext|>", "漢", ".", "🙂", "▁", "<s>", "<0x0A>", "aaaa", "==", "the", "\0", " word"]


def texts(n, size, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, size))) for _ in range(n)]


EDGES = [None, "", " ", "   ", "\n", "a" * 3000, "ab " * 900, " " * 700, "the " * 500 + "x" * 900 + " the" * 300, "<|endoftext|>" * 60, "漢字" * 500]


@pytest.mark.parametrize("chunk,overlap", [(64, 32), (200, 48), (32_768, 1_024)])
def test_counts_match_the_library(documents, chunk, overlap):
    rows = [(i, t) for i, t in enumerate([*EDGES, *texts(150, 250)])]
    rows += [(None, "no id " * 40), (5, rows[5][1]), (5, "same id, other text " * 30)]  # repeated rows, shared and missing ids
    lib = token_counts.load(JSON)
    want = sorted((str(i), len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    out = token_counts.count_tokens(documents(rows), JSON, chunk_chars=chunk, overlap_chars=overlap).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in out)
    assert chunk > 1000 or any(r.n_windows > 1 for r in out)


def test_counts_of_nothing(documents):
    assert token_counts.count_tokens(documents([]), JSON).collect() == []


def test_parts_are_independent():
    lib = token_counts.load(JSON)
    sample = texts(4000, 60, seed=2)
    assert token_counts.splits_at_spaces(lib)
    assert token_counts.counted_by_part(lib, sample, {}) == token_counts.counted(lib, sample)


def test_word_tokenizer_is_counted_whole(documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = token_counts.load(path)
    assert not token_counts.splits_at_spaces(lib)
    rows = list(enumerate(texts(40, 60)))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(documents(rows), path).collect()}
    assert got == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_pieces_match_the_library():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = pieces.PieceModel(MODEL)
    rng = random.Random(3)
    sample = [t for t in EDGES if t is not None] + texts(1500, 80) + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz=/0123") for _ in range(2000))] + [" " * n + "the" for n in range(40)]
    got = pieces.encode_texts(model, sample)
    assert [g.tolist() for g in got] == lib.encode(sample)
    assert [model.decode(g) for g in got] == lib.decode([g.tolist() for g in got])
    for _ in range(2000):  # any ids, also invalid bytes
        ids = [rng.randrange(32_000) if rng.random() < 0.3 else rng.randrange(260) for _ in range(rng.randrange(12))]
        assert model.decode(np.array(ids, dtype=np.int64)) == lib.decode(ids)


def test_agenda_equals_rounds(monkeypatch):
    model = pieces.PieceModel(MODEL)
    sample = [t for t in texts(300, 60, seed=9)]
    want = [g.tolist() for g in pieces.encode_texts(model, sample)]
    monkeypatch.setattr(pieces, "ROUNDS", 0)
    assert [g.tolist() for g in pieces.encode_texts(model, sample)] == want


def test_round_trip_rows(documents):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t) for i, t in enumerate([*EDGES, *texts(60, 100)])] + [(None, "x y"), (3, " "), (3, " ")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((str(i), len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))) for i, t in rows for ids in [lib.encode(t or "")])
    df = documents(rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.round_trip(df, MODEL).collect()) == want
    back = pieces.decode(pieces.encode(df, MODEL), MODEL)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), lib.decode(lib.encode(t or ""))) for i, t in rows)
    assert pieces.round_trip(documents([]), MODEL).collect() == []
