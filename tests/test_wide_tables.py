"""Pivots and one-hot codes with more categories than a table has columns; filters in blocks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import encode, fourier
from tidewatch.operators import metrics_query as mq

MANY = 20_011


def test_one_hot_of_many_categories(spark):
    train = spark.range(MANY).select(F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("c"), "id")
    cells = {r["id"]: (r.position, r.size) for r in encode.one_hot_cells(train, train, "c").collect()}
    assert cells == {i: (i - 1 if i else None, MANY - 1) for i in range(MANY)}
    some = train.where("id IN (0, 1, 7000, 20010)").withColumn("x", F.lit(1))
    vectors = {r["id"]: r.vector for r in encode.one_hot_vector(train, some, "c").collect()}
    assert all(v.size == MANY - 1 for v in vectors.values())
    assert {i: v.indices.tolist() for i, v in vectors.items()} == {0: [], 1: [0], 7000: [6999], 20010: [20009]}
    with pytest.raises(ValueError):
        encode.one_hot(train, some, "c")


def test_cells_equal_columns_and_unseen_values(spark):
    train = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("b", 4), (None, 5)], "c string, x int")
    known = train.where("c IS NOT NULL")
    wide = {r.x: [r["c_b"], r["c_c"]] for r in encode.one_hot(known, known, "c").collect()}
    cells = {r.x: [int(r.position == i) for i in range(r["size"])] for r in encode.one_hot_cells(known, known, "c").collect()}
    assert cells == wide
    other = spark.createDataFrame([("z", 1), ("a", 2)], "c string, x int")
    with pytest.raises(ValueError):
        encode.one_hot_cells(known, other, "c")
    loose = {r.x: (r.position, r["size"]) for r in encode.one_hot_cells(known, other, "c", check=False).collect()}
    assert loose == {1: (None, None), 2: (None, 2)}


def events(spark, positions):
    rows = []
    for i, p in enumerate(positions):
        tags = {"connector_name": "client", mq.POSITION_TAG: p, mq.WINDOW_TAG: "60000"}
        rows += [("a", "v", i % 3, mq.REQUESTS, float(i % 5), tags), ("a", "v", i % 3, mq.RESPONSE_TIME, 2e6 * i, tags)]
    entry = {mq.ENTRY_TAG: "true", mq.WINDOW_TAG: "60000", "connector_name": "x"}
    rows += [("a", "v", t, mq.IN_PROGRESS, 1.0 + t, entry) for t in range(4)]
    df = spark.createDataFrame(rows, "app_id string, version string, t int, metric_name string, value double, tags map<string,string>")
    return df.withColumn("timestamp", F.timestamp_seconds("t"))


def test_pivot_of_many_positions(spark):
    positions = [f"p{i}" for i in range(12_000)]
    df = events(spark, positions)
    with pytest.raises(ValueError):
        mq.connection_metrics(df, "client")
    got = mq.connection_cells(df, "client").collect()
    assert len(got) == 12_001 and sum(r.position is None for r in got) == 1
    for r in got:
        if r.position is None:
            assert (r.t if "t" in r else r.timestamp.second) == 3 and r.out_throughput == 0 and r.in_ipr == 4
        else:
            i = int(r.position[1:])
            assert r.timestamp.second == i % 3 and np.isclose(r.out_throughput, (i % 5) / 60000 * 1000)
            assert np.isclose(r.out_avg_response_time, 2e6 * i / (i % 5) / 1e6 if i % 5 else 0.0)


def test_cells_equal_the_pivot(spark):
    df = events(spark, ["p0", "p1", "p2", "p0", "p1"])
    wide = mq.connection_metrics(df, "client").toPandas().set_index("timestamp")
    for r in mq.connection_cells(df, "client").where("position IS NOT NULL").collect():
        for x in mq.OUTBOUND:
            assert r[f"out_{x}"] == wide.loc[pd.Timestamp(r.timestamp), f"out_{x}_{r.position}"]


def test_filter_offsets_in_blocks(spark):
    sizes = spark.createDataFrame([(1, 2), (7, 16), (400, 1024)], "_n long, _m long")
    for block in (3, 50, 100_000):
        got = fourier._offsets(sizes, block).groupBy("_n").agg(F.sort_array(F.collect_list("_s")).alias("s")).collect()
        assert {r["_n"]: r.s for r in got} == {n: list(range(1 - n, n)) for n in (1, 7, 400)}


def test_spectrum_with_a_filter_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(fourier, "INDEX_BLOCK", 50)
    v = np.random.default_rng(5).normal(size=333)
    rows = spark.createDataFrame(pd.DataFrame({"s": "a", "pos": range(333), "n": 333, "v": v}))
    got = fourier.any_length(rows, ["s"], "pos", "n", F.col("v")).toPandas().sort_values("bin")
    want = np.fft.fft(v)
    assert np.allclose(got["re"], want.real) and np.allclose(got["im"], want.imag)
