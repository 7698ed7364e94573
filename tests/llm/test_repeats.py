"""Repeated strings against a set of all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import repeats


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(data, gone) if not g)).hexdigest())
    return out


def corpus(length, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(10, 4 * length))) for _ in range(12)] + ["a" * (3 * length), "ab" * (2 * length), "\0\1" * length]
    filler = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, length)))
    rows = ["".join(rng.choice(parts) if rng.random() < 0.6 else filler() for _ in range(rng.randint(0, 6))) for _ in range(100)]
    return list(enumerate([None, "", parts[0] * 3, *rows]))


@pytest.mark.parametrize("length,gram,group", [(20, 8, 20_000), (20, 8, 3), (100, 32, 20_000), (100, 32, 4)])
def test_removed_bytes(documents, length, gram, group):
    rows = corpus(length, length + group)
    out = repeats.remove_repeats(documents(rows), length, gram, group).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute(rows, length)


def test_long_texts_in_slices(documents, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 700)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(400))
    rows = [(i, "".join(rng.choice("abcdefghij ") for _ in range(900)) + passage + "".join(rng.choice("xyz") for _ in range(900))) for i in range(4)]
    keyed = [repeats.fragments_of([t.encode()], 100, 32) for _, t in rows]
    covered = [sorted(p for a, n in zip(f[3], f[4]) for p in range(a, a + n)) for f in keyed]
    assert all(set(c) == set(range(len(t) - 99)) for c, (_, t) in zip(covered, rows))
    out = repeats.remove_repeats(documents(rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute(rows, 100)


def test_repeated_rows_missing_ids_empty_table(documents):
    text = "0123456789" * 30
    out = repeats.remove_repeats(documents([(None, "z" * 150), (1, text), (1, text), (2, text), (3, "z" * 150)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in out) == sorted([("None", 149), ("1", 290), ("1", 290), ("2", 300), ("3", 150)])
    assert repeats.remove_repeats(documents([])).collect() == []


def test_groups_have_all_occurrences():
    """Maximal repeats of one group of fragments against all substrings."""
    rng = random.Random(2)
    length = 12
    core = "".join(rng.choice("ab") for _ in range(16))
    data = [("x" if i % 2 else "y") + core + rng.choice(["", "c", "cd", "e"]) + "fg"[i % 2] * 3 for i in range(9)]
    count = [len(d) - 1 - length + 1 for d in data]
    t = pa.table({"doc": list(range(9)), "h": [0] * 9, "lo": [0] * 9, "count": count, "data": [d.encode() for d in data]})
    found = repeats.repeat_groups(t, np.array([0, 9]), length).to_pandas()
    got = {(g.n_bytes.iloc[0], frozenset(zip(g.doc, g.start))) for _, g in found.groupby("repeat")}
    want = {}
    for i, d in enumerate(data):
        for s in range(1, len(d)):
            for e in range(s + length, len(d) + 1):
                want.setdefault(d[s:e], set()).add((i, s - 1))
    full = {(len(w), frozenset(o)) for w, o in want.items() if len(o) > 1}
    # right-maximal: no longer string with the same occurrences; left: some occurrence opens its fragment or they differ in front
    keep = set()
    for n, o in full:
        if any(m > n and p == o for m, p in full):
            continue
        front = {None if s == 0 else data[i][s] for i, s in o}
        if None in front or len(front) > 1:
            keep.add((n, o))
    assert got == keep
