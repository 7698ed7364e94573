"""Statistics against plain counting; learned lists on planted labels."""

import random
import re

import numpy as np

from tidewatch.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics(documents):
    rng = random.Random(1)
    bits = ["a", "b", "é", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", " ", "#", "<", "漢", "ab "]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 90)))) for i in range(200)] + [(900, None), (None, "x " * 80), (901, "u v w " * 5000)]
    out = rules.statistics(documents(rows)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    want = []
    for i, t in rows:
        c = plain(t or "") if len(t or "") < 20_000 else (15_000, 15_000, 0, 0, 15_000)
        want.append((str(i), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want)


def corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(60, 120))]
        poor = rng.random() < 0.25
        if poor and rng.random() < 0.5:
            words = [w + "|#" if rng.random() < 0.5 else w for w in words]
        elif poor:
            words = [w + "77" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if poor else 1))
    return rows, labels


def test_learned_list(spark, documents):
    rng = random.Random(7)
    rows, labels = corpus(rng, 900)
    names = "doc_id long, quality int"
    fit = [(i, q) for i, q in labels if i < 600] + [(None, 0), (3, None)]
    table = spark.createDataFrame(fit, names)
    df = documents([*rows, (None, "few words"), (5000, None)])
    learned = rules.learn(df, table)
    assert 1 <= len(learned) <= rules.MAX_RULES and all(1 <= len(r) <= rules.MAX_CONDITIONS for r in learned)
    kept = {r.doc_id: r.kept for r in rules.judge(df, table).collect()}
    assert sum(kept[i] == bool(q) for i, q in labels if i >= 600) >= 297  # held out
    assert not kept[None] and not kept[5000]
    stayed = rules.keep(df, table)
    assert stayed.columns == df.columns
    assert sorted(r.doc_id for r in stayed.collect()) == sorted(i for i, k in kept.items() if k)


def test_without_labels_or_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    good = " ".join(f"w{i}" for i in range(60))
    assert [r.kept for r in rules.judge(documents([(1, good), (1, good)]), none).collect()] == [True, True]
    assert rules.judge(documents([]), none).collect() == []
    assert rules.keep(documents([]), none).collect() == []


def test_noise_is_not_learned():
    rng = np.random.default_rng(3)
    assert rules.cover(rng.random((600, 4)), rng.random(600) < 0.3, list("abcd")) == []


def test_conjunction_is_found():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    poor = (x[:, 0] > 0.6) & (x[:, 1] <= 0.4)
    found = rules.cover(x, poor, ["a", "b", "c"])
    hit = np.zeros(len(x), dtype=bool)
    for r in found:
        hit |= rules._covered(r, x, ["a", "b", "c"])
    assert (hit == poor).mean() > 0.97
