"""Mixing, line spread and archives."""

import base64
import hashlib
import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidewatch.llm import line_spread, mixing, warc
from tidewatch.llm.common import new_path


def poisson_inverse(mean, u):
    k, p = 0, math.exp(-mean)
    s = p
    while s < u and k < 80:
        k += 1
        p *= mean / k
        s += p
    return k


def copies(doc_id, rate, seed=1, text=""):
    who = hashlib.md5((text or "").encode()).hexdigest() if doc_id is None else doc_id
    parts = max(math.ceil(rate / 16), 1)
    total = 0
    for i in range(1, parts + 1):
        u = (int(hashlib.md5(f"{seed}|{who}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        total += poisson_inverse(rate / parts, u)
    return total


def mix_rows():
    rows = [(i, "x" * (1 + i % 7), "hot") for i in range(3000)] + [(5000 + i, "y" * 9, f"s{i % 5}") for i in range(400)] + [(6000 + i, "z" * 5, "tiny") for i in range(20)]
    return rows + [(None, "no id", "s1"), (7000, None, "s2"), (7001, "abc", None), (7002, None, "only empty"), (7003, "", "only empty"), (1, "x" * 2, "hot")]


def test_mixing_counts(documents):
    rows = mix_rows()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t or "")
    total = sum(size.values())
    rate = {s: total / (len(size) * n) if n else 1.0 for s, n in size.items()}
    want = Counter()
    for i, t, s in rows:
        want[(i, t, s)] += copies(i, rate[s], text=t)
    out = mixing.mix(documents(rows)).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in out) == +want
    assert max(rate.values()) > 16  # some draws have parts
    got = Counter()
    for r in out:
        got[r.source] += len(r.text or "")
    assert abs(got["hot"] / sum(got.values()) - 1 / len([n for n in size.values() if n])) < 0.05
    assert [r.doc_id for r in out] != sorted((r.doc_id for r in out), key=lambda i: -1 if i is None else i)


def test_rows_without_an_id_are_spread(spark, documents):
    """Hot missing ids: own draws, and no partition with most of the rows."""
    rows = [(None, f"text {i}", "s") for i in range(2000)] + [(7, f"other {i}", "t") for i in range(1000)]
    mixed = mixing.mix(documents(rows))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small partitions are put together
    try:
        per_part = Counter(r[0] for r in mixed.select(F.spark_partition_id()).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(per_part.values()) < 0.6 * sum(per_part.values())
    drawn = Counter(r.text for r in mixed.collect() if r.doc_id is None)
    assert len({drawn.get(f"text {i}", 0) for i in range(2000)}) > 1


def test_mixing_weights_and_salts(documents, monkeypatch):
    df = documents(mix_rows())
    plain = sorted(map(str, mixing.mix(df, {"hot": 3.0, "s1": 1.0}).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.mix(df, {"hot": 3.0, "s1": 1.0}).collect())) == plain
    assert {r.source for r in mixing.mix(df, {"hot": 3.0}).collect()} <= {"hot", "only empty"}
    assert mixing.mix(documents([])).collect() == []


def brute_lines(rows, min_sites, min_chars=0):
    """Sites of every line that is not blank, equal whole texts on their first site only."""
    site_of = {}
    for _, t, s in rows:
        if t is not None:
            site_of[t] = min(s or "\x01", site_of.get(t, s or "\x01"))
    sites = defaultdict(set)
    for t, s in site_of.items():
        for x in t.split("\n"):
            if x.strip(" \t\n\x0b\x0c\r"):
                sites[x.strip(" ")].add(s)

    def need(x):
        return min_sites + math.ceil(max(min_chars - len(x), 0) * min_sites / max(min_chars, 1))

    bad = {x for x in sites if len(sites[x]) >= need(x)}
    out = []
    for d, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        left = [x for x in lines if x.strip(" ") not in bad]
        out.append((str(d), None if t is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


def line_rows():
    rows = []
    for i in range(300):
        site = f"site{i % 14}" if i % 3 else "hot"
        body = [f"own line number {i} of this text", "Of."]
        if i % 2:
            body.insert(i % 3, "All rights reserved by all of us")
        if i % 14 < 6:
            body.append("  a line of six sites or seven  ")
        if i % 14 < 9:
            body.insert(0, f"nearly on ten sites, context {i % 1}")
        rows.append((i, "\n".join(body), site))
    rows += [(1000 + i, "copied article, line one\ncopied article, line two\n\ncopied article, line three", f"site{i}") for i in range(14)]
    return rows + [(2000, None, "hot"), (2001, "", "hot"), (2002, "All rights reserved by all of us", None), (None, "All rights reserved by all of us\nrest", "x"), (5, rows[5][1], rows[5][2])]


def cleaned(df, *args):
    return sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in line_spread.remove_spread_lines(df, *args).collect()), key=str)


def test_line_spread(documents):
    rows = line_rows()
    for min_sites, min_chars in ((10, 0), (7, 20), (2, 0), (11, 40)):
        assert cleaned(documents(rows), min_sites, min_chars) == brute_lines(rows, min_sites, min_chars)
    assert line_spread.remove_spread_lines(documents([])).collect() == []


def test_copies_keep_their_lines(documents):
    out = {r.doc_id: r.n_removed for r in line_spread.remove_spread_lines(documents(line_rows())).collect()}
    assert all(out[1000 + i] == 0 for i in range(14)) and out[13] > 0


def test_whole_blocks_and_short_lines_go(documents):
    """A notice of four lines on 12 sites, a short menu entry among them; rows without an id apart."""
    block = "Home page of the site\nMenu\n  Terms of use apply here\n\nAll rights reserved"
    rows = [(i if i % 5 else None, f"own {i} text\n{block}\nmore of {i}", f"s{i % 12}") for i in range(36)]
    rows += [(100 + i, f"nine sites only\nown {i}", f"s{i}") for i in range(9)]
    got = cleaned(documents(rows))
    assert got == brute_lines(rows, 10)
    assert all(r[3] == 4 and "\n\n" in r[1] for r in got if r[1].startswith("own") and "text" in r[1])
    assert all(r[3] == 0 for r in got if r[1].startswith("nine"))


PAGES = "page_id long, url string, html string, n string, digest string"


def pages():
    same = "<p>same\r\n\r\nbody</p>"
    tricky = ["WARC/1.0\r\n", "a\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n", "\r\n\r\n", "x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 9999\r\n\r\n" + "y" * 50, "é漢🙂\n"]
    rows = [(i, f"http://h{i % 3}/{i}", tricky[i % len(tricky)] * (i % 4) if i % 2 else f"page {i} " * (i % 9)) for i in range(60)]
    rows += [(100 + i, None, same) for i in range(40)] + [(90, "u", None), (91, "line\r\nbreak", ""), (None, "v", "lonely"), (None, "v", same), (300, "w", "z" * 300_000), (301, "w", "z" * 300_000), (302, "t", "tie"), (302, "t", "tie")]
    return [(*r, "clash", "clash") for r in rows]


def brute_pages(rows):
    first = {}
    for i, _, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, _, t, *_ in rows:
        data = (t or "").encode()
        f = first.get(t or "")
        out.append((str(i), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    return sorted(out, key=str)


def test_archive(spark):
    rows = pages()
    out = warc.archive_pages(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=str) == brute_pages(rows)
    assert warc.archive_pages(spark.createDataFrame([], PAGES)).collect() == []


def test_archive_bytes(spark):
    """The files are WARC: parse them by Content-Length alone."""
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    path = new_path(spark, "warc-test")
    warc.write_archive(df.repartition(3), path)
    kinds, bodies = Counter(), Counter()
    for r in spark.read.format("binaryFile").load(path).collect():
        data, at = bytes(r.content), 0
        while at < len(data):
            head, _, _ = data[at:].partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.0\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            body = data[at + len(head) + 4 : at + len(head) + 4 + n]
            assert data[at + len(head) + 4 + n :][:4] == b"\r\n\r\n"
            at += len(head) + 8 + n
            kinds[fields["WARC-Type"]] += 1
            if fields["WARC-Type"] == "response":
                bodies[body] += 1
                assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            else:
                assert "WARC-Refers-To" in fields and n == 0
    want = Counter(r[3] for r in brute_pages(rows))
    assert kinds == want
    read = warc.read_archive(spark, path).where("kind = 'response'").collect()
    assert Counter(bytes(r.payload) for r in read) == bodies


def test_small_payloads_are_not_revisits(spark):
    rows = [(1, "u", "ab", "", ""), (2, "u", "ab", "", ""), (3, "u", "long enough", "", ""), (4, "u", "long enough", "", "")]
    out = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(rows, PAGES), min_bytes=5).collect()}
    assert out == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
