"""Exact duplicates by chunk recipes, against dictionaries of whole texts."""

import hashlib
import string
from collections import defaultdict

import pytest

from tidewatch.llm import chunk_recipes

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def texts():
    long = " ".join(f"Sentence number {i} is here. And É stays\n" if i % 3 else f"Weiter {i}! " for i in range(600))
    rows = [(i, long) for i in range(40, 50)] + [(50, long.upper()), (51, long + "x"), (52, "x" + long), (53, long.replace("É", "é"))]
    rows += [(i, f"text {i % 7}") for i in range(40)] + [(100, "TEXT 3"), (101, None), (102, ""), (103, " "), (104, "\n"), (None, "text 3"), (None, "no id"), (None, "no id")]
    rows += [(200, "tie"), (200, "tie"), (200, "TIE"), (201, "x" * 100_000), (202, "X" * 100_000), (203, "x" * 99_999), (204, "文字。" * 3000), (205, "文字。" * 3000)]
    return rows


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            out.append((str(i), keep, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits,deal", [(64, 20_000), (64, 3), (3, 20_000), (0, 4)])
def test_equal_texts(documents, bits, deal):
    rows = texts()
    out = chunk_recipes.equal_texts(documents(rows), bits=bits, deal=deal).collect()
    assert sorted(((str(r.doc_id), r.keep_id, r.group_size, r.text_sha256) for r in out), key=str) == brute(rows)
    kept = [r for r in out if r.kept]
    assert len(kept) == len({r.text_sha256 for r in out}) == len({r.text_sha256 for r in kept})  # one of each
    assert all(r.doc_id == r.keep_id for r in kept)


def test_chunks_cover_the_text(documents):
    df = documents(texts())
    for shortest, longest in ((256, 2048), (2, 5), (1, 2)):
        for r in df.select("text", chunk_recipes.chunks_of(chunk_recipes.text_of("text"), shortest, longest).alias("chunks")).collect():
            assert "".join(r.chunks) == (r.text or "")
            assert all(shortest <= len(c) <= longest for c in r.chunks[:-1])


def test_chunks_come_back_after_an_insertion(documents):
    """An inserted word changes the chunks around it, not those behind."""
    word = lambda i: hashlib.md5(str(i).encode()).hexdigest()[:5]
    body = "".join(f"sentence {i} {word(i)} and a {word(i * i)} had been made by {word(i + 7)}. " for i in range(400))
    df = documents([(1, body), (2, "One more start. " + body), (3, body[:9000] + "inserted " + body[9000:])])
    got = {r.id: r.recipe for r in chunk_recipes.recipes(df).collect()}
    for other in (2, 3):
        assert len(set(got[1]) & set(got[other])) >= len(got[1]) - 8 > 20


def test_without_copies(documents):
    rows = texts()
    df = documents(rows)
    out = chunk_recipes.without_copies(df)
    assert out.columns == df.columns
    left = out.collect()
    assert len(left) == len({(t or "").translate(LOWER) for _, t in rows})
    assert {r.doc_id for r in left if r.text == "tie" or r.text == "TIE"} == {200}


def test_empty_tables(documents):
    assert chunk_recipes.equal_texts(documents([])).collect() == []
    assert chunk_recipes.without_copies(documents([])).collect() == []
