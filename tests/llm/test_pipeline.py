"""The pipeline against its stages done by brute force, and every registered query."""

import sys
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from tests.llm.test_native import brute_lines, copies  # noqa: E402
from tests.llm.test_pairs import brute  # noqa: E402
from tests.llm.test_rules import plain  # noqa: E402
from tidewatch.llm import rules  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}

    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality"](spark, docs, SF)
    learned = rules.learn(docs, labels)
    judged = {r.doc_id: r.kept for r in rules.judge(docs, labels).collect()}
    kept = [r for i, r in rows.items() if judged[i]]
    for i, r in rows.items():
        n, _, _, _, repeat = plain(r.text)
        assert not (judged[i] and (n < 50 or 100 * repeat > 50 * n))
    assert one.columns == columns and sorted(map(str, one.collect())) == sorted(map(str, kept)) and isinstance(learned, list)

    two = stage["lines"](spark, one, SF)
    want = brute_lines([(r.doc_id, r.text, r.source) for r in kept], 10, 20)
    assert two.columns == columns and sorted(((str(r.doc_id), r.text) for r in two.collect()), key=str) == sorted(((i, t) for i, t, _, _ in want), key=str)

    three = stage["near_duplicates"](spark, two, SF)
    left = {int(i): t for i, t, _, _ in want}
    found = brute(list(left.items()), 5, 80)
    stay = {i for i, (_, c) in found.items() if c == i}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == stay

    four = stage["mixing"](spark, three, SF)
    size = Counter()
    for i in stay:
        size[rows[i].source] += len(left[i])
    total = sum(size.values())
    times = Counter({i: copies(i, total / (len(size) * size[rows[i].source]) if size[rows[i].source] else 1.0) for i in stay})
    assert four.columns == columns and Counter(r.doc_id for r in four.collect()) == +times

    five = corpus_pipeline.run(spark, SF)
    assert Counter(r.doc_id for r in five.collect()) == +times


def test_lines_stage_on_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = dict(corpus_pipeline.STAGES)["lines"](spark, docs, SF)
    want = brute_lines([(r.doc_id, r.text, r.source) for r in docs.collect()], 10, 20)
    assert sum(w[3] for w in want) > 100
    assert sorted(((str(r.doc_id), r.text) for r in out.collect()), key=str) == sorted(((i, t) for i, t, _, _ in want), key=str)


def test_near_duplicates_with_repeated_and_missing_ids(spark, documents):
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(5, text), (5, text), (None, text), (3, text + " end"), (None, other), (None, other), (7, "unlike anything else " + other[:90]), (8, None), (8, None)]
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, documents(rows, clash=False), SF)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(3, text + " end"), (None, other), (7, "unlike anything else " + other[:90]), (8, None), (8, None)], key=str)


def test_empty_table(spark, documents):
    docs = documents([], clash=False)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


LLM = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]


@pytest.mark.parametrize("name", LLM)
def test_query_returns_its_whole_table(spark, name):
    own = {"op5_warc_revisits": ("pages", "page_id"), "op9_sorted_projections": ("embeddings", "vec_id"), "op11_metric_trees": ("embeddings", "vec_id"), "op13_subset_sums": ("embeddings", "vec_id")}
    table, key = own.get(name, ("documents", "doc_id"))
    out = entry.queries()[name](spark, SF)
    ids = [r[0] for r in out.select("anchor_id" if name == "op13_subset_sums" else key).collect()]
    all_ids = [r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()]
    if name == "op13_subset_sums":
        assert set(ids) == {i for i in all_ids if i % 100 == 0}
    elif name == "op2_poisson_mixing":
        assert set(ids) <= set(all_ids) and len(ids) > 0
    else:
        assert sorted(ids) == sorted(all_ids)
