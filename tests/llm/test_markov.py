"""The hidden Markov model against plain recursions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import hidden_markov as hm
from tidewatch.llm.words import words_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def rows(n=300, seed=2):
    rng = random.Random(seed)
    kinds = [["la", "le", "un", "que", "pas"], ["der", "die", "und", "ein", "zu"]]
    out = []
    for i in range(n):
        words = kinds[i % 2]
        out.append((i, " ".join(rng.choice(words) + rng.choice(["", "", "ion", "ung"]) + (str(rng.randrange(30)) if rng.random() < 0.2 else "") for _ in range(rng.randint(0, 60)))))
    return out + [(1000, None), (None, "la Le\n LA\tder"), (1001, ""), (3, out[3][1]), (1002, "word " * 3000), (1003, "Ünïcode ÉÉ  x\x0by\x0cz\x1cw")]


def test_words():
    rng = random.Random(1)
    sample = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", "É"]) for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for array in (pa.array(sample), pa.array(["pad", *sample, "pad"]).slice(1, len(sample))):
        got = words_of(array)
        listed = got.words.to_pylist()
        for i, t in enumerate(sample):
            assert [listed[c] for c in got.codes[got.text(i)]] == WORD.findall(t.encode().lower())


def plain_forward(seq, m):
    a = m.start * m.emit[:, seq[0]]
    total = 0.0
    for t, o in enumerate(seq):
        if t:
            a = (a @ m.move) * m.emit[:, o]
        total += math.log10(a.sum())
        a = a / a.sum()
    return total


def plain_counts(seqs, m):
    k = len(m.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
    for s in seqs:
        a = [m.start * m.emit[:, s[0]]]
        for o in s[1:]:
            a.append((a[-1] @ m.move) * m.emit[:, o])
        b = [np.ones(k)]
        for o in s[:0:-1]:
            b.insert(0, m.move @ (m.emit[:, o] * b[0]))
        z = a[-1].sum()
        start += a[0] * b[0] / z
        for t, o in enumerate(s):
            emit[:, o] += a[t] * b[t] / z
            if t:
                move += m.move * np.outer(a[t - 1], m.emit[:, o] * b[t]) / z
    return start, move, emit


@pytest.fixture
def model():
    rng = np.random.default_rng(3)
    return hm.Model(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(9), 4))


def test_recursions(model, monkeypatch):
    rng = np.random.default_rng(4)
    seqs = [rng.integers(0, 9, n).astype(np.int32) for n in (1, 2, 5, 30, 30, 7, 1, 64)]
    for held_tokens in (10, 50, 10_000):
        monkeypatch.setattr(hm, "HELD_TOKENS", held_tokens)
        assert np.allclose(hm.likelihoods(seqs, model), [plain_forward(s, model) for s in seqs])
        got = [np.zeros(4), np.zeros((4, 4)), np.zeros((4, 9))]
        for g in hm.grouped(seqs):
            lattice = hm.Lattice([seqs[i] for i in g], model)
            lattice.forward()
            got = [x + y for x, y in zip(got, lattice.counts())]
        for x, y in zip(got, plain_counts(seqs, model)):
            assert np.allclose(x, y)


def test_long_sequences_do_not_underflow(model):
    seq = np.random.default_rng(5).integers(0, 9, 20_000).astype(np.int32)
    lattice = hm.Lattice([seq, seq[:3]], model)
    log = lattice.forward()
    assert np.isfinite(log).all() and abs(log[0] / plain_forward(seq, model) - 1) < 1e-9
    assert all(np.isfinite(x).all() for x in lattice.counts())


def test_extreme_parameters():
    """States that are all but certain, and sequences that contradict them."""
    rng = np.random.default_rng(8)
    for tiny in (1e-8, 1e-10, 1e-13, 1e-40):
        k = 3
        move = np.full((k, k), tiny) + np.eye(k)
        emit = np.full((k, 6), tiny)
        emit[np.arange(k), np.arange(k)] = 1
        m = hm.Model(np.array([1, tiny, tiny]), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        seqs = [rng.integers(0, 6, n).astype(np.int32) for n in (400, 90, 12, 1)]
        lattice = hm.Lattice(seqs, m)
        log = lattice.forward()
        assert np.isfinite(log).all() and np.allclose(log, [plain_forward(s, m) for s in seqs], rtol=1e-9)
        start, moves, emits = lattice.counts()
        assert all(np.isfinite(x).all() for x in (start, moves, emits))
        assert np.isclose(emits.sum(), sum(map(len, seqs))) and np.isclose(moves.sum(), sum(len(s) - 1 for s in seqs)) and np.isclose(start.sum(), len(seqs))


def test_rounds_go_on_until_the_likelihood_is_flat(documents):
    """At least as good on held-out texts as many fixed rounds, and better than few."""
    data = rows(500, seed=4)
    small = {"states": 4, "n_own": 6, "n_endings": 16}

    def held_out_score(**settings):
        out = hm.score(documents(data), **small, **settings).collect()
        return sum(r.score for r in out if r.held_out) / sum(r.n_tokens for r in out if r.held_out)

    flat = held_out_score(tolerance=0.0005)
    assert flat > held_out_score(rounds=1) and flat > held_out_score(rounds=25) - 0.01


@pytest.mark.parametrize("batch_bytes", [8_000_000, 4_000])
def test_scores(documents, batch_bytes):
    data = rows()
    small = {"states": 3, "rounds": 2, "n_own": 6, "n_endings": 8}
    out = hm.score(documents(data), batch_bytes=batch_bytes, **small).collect()
    tokens = [(i, [*WORD.findall((t or "").encode().lower()), b""]) for i, t in data]
    train = Counter(w for i, t in tokens if not held(i) for w in t)
    n, v = sum(train.values()), len(train)
    want = sorted((str(i), held(i), len(t), sum(train[w] > 0 for w in t), n, round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for i, t in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    # the model: the same rounds by plain recursions
    top = [w for w, _ in sorted(((w, c) for w, c in train.items() if w), key=lambda x: (-x[1], x[0]))[:6]]
    classes = hm.Classes(top, 6, 8)
    kinds = list({w for _, t in tokens for w in t})
    of = dict(zip(kinds, classes.of(pa.array(kinds, pa.large_binary())).tolist()))
    share, words, distinct = np.full(classes.size, 0.1), np.zeros(classes.size), np.zeros(classes.size)
    for w, c in train.items():
        share[of[w]] += c
        words[of[w]] += c
        distinct[of[w]] += 1
    share /= share.sum()
    m = hm.first_model(share, 3)
    seqs = [[of[w] for w in t] for i, t in tokens if not held(i)]
    for _ in range(2):
        a, b, c = (x / x.sum(axis=-1, keepdims=True) for x in [y + z for y, z in zip(_scaled_counts(seqs, m), (1 / 3, 1 / 3, 10 * share))])
        m = hm.Model(a, b, c)
    got = {(r.doc_id, r.n_tokens): r.score for r in out}
    for i, t in tokens:
        inner = sum(math.log10((train[w] + 0.1) / (words[of[w]] + 0.1 * (distinct[of[w]] + 1))) for w in t if 6 <= of[w] < 14)
        assert abs(got[(i, len(t))] - (plain_forward([of[w] for w in t], m) + inner)) < 2e-3 * max(1, len(t) ** 0.5)


def _scaled_counts(seqs, m):
    """plain_counts with scaling, for long sequences."""
    k = len(m.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
    for s in seqs:
        a = np.zeros((len(s), k))
        for t, o in enumerate(s):
            a[t] = (m.start if t == 0 else a[t - 1] @ m.move) * m.emit[:, o]
            a[t] /= a[t].sum()
        b = np.ones(k)
        for t in range(len(s) - 1, -1, -1):
            g = a[t] * b / (a[t] @ b)
            emit[:, s[t]] += g
            if t:
                e = m.emit[:, s[t]] * b
                x = m.move * np.outer(a[t - 1], e)
                move += x / x.sum()
                b = m.move @ e
                b /= b.sum()
            else:
                start += g
    return start, move, emit


def test_held_out_texts_gain(documents):
    data = rows(600, seed=9)
    out = hm.score(documents(data), states=4, rounds=6, n_own=6, n_endings=16).collect()
    mine = [r for r in out if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in mine) > sum(r.base_score for r in mine)


def test_nothing_to_learn_from(documents):
    assert hm.score(documents([])).collect() == []
    [r] = hm.score(documents([(None, "some text")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and math.isfinite(r.score)
