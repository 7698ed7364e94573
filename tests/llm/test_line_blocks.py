"""Boilerplate of several lines and of short lines."""

from tidewatch.llm import line_spread

MENU = ["first line of the site menu", "second line of the site menu", "third line of the site menu", "fourth line of the site menu"]


def test_inner_lines_of_a_block_go(documents):
    rows = [(i, "\n".join([f"own opening of the document {i}", *MENU, f"own ending of the document {i}"]), f"site{i}") for i in range(12)]
    rows += [(100 + i, "copied article, line one\ncopied article, line two\ncopied article, line three", f"site{i}") for i in range(12)]
    out = {r.doc_id: (r.text, r.n_removed) for r in line_spread.remove_spread_lines(documents(rows)).collect()}
    assert all(out[i] == (f"own opening of the document {i}\nown ending of the document {i}", 4) for i in range(12))
    assert all(out[100 + i] == (rows[12 + i][1], 0) for i in range(12))


def test_pipeline_takes_whole_blocks(spark, documents):
    import corpus_pipeline

    rows = [(i, "\n".join([f"own opening of the document {i}", *MENU, f"own ending of the document {i}"]), f"site{i}") for i in range(12)]
    out = dict(corpus_pipeline.STAGES)["lines"](spark, documents(rows, clash=False), "").collect()
    assert all(r.text == f"own opening of the document {r.doc_id}\nown ending of the document {r.doc_id}" for r in out)


def test_short_lines_need_more_sites(documents):
    rows = [(i, f"own opening of the document {i}\nRead more\n\r\n{'Share this' if i < 14 else 'x'}\nown ending of the document {i}", f"site{i}") for i in range(19)]
    out = {r.doc_id: r.text for r in line_spread.remove_spread_lines(documents(rows), min_chars=20).collect()}
    # 9 characters: 16 of 19 sites; 10 characters: 15, but 14 have the line; blank lines stay
    assert all(out[i] == rows[i][1].replace("Read more\n", "") for i in range(19))
