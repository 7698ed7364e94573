"""Repeats whose fragments have long tails."""

import pytest

from tests.llm.test_repeats import brute, corpus
from tidewatch.llm import repeats


@pytest.mark.parametrize("length,gram", [(200, 32)])
def test_removed_bytes_with_long_tails(documents, length, gram):
    rows = corpus(length, 7)
    out = repeats.remove_repeats(documents(rows), length, gram).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == brute(rows, length)
