"""Steps whose memory, disk or files must not grow with a whole table."""

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import balance, fourier, neighbors, split
from tidewatch.plans import model_queries
from tidewatch.series import SeriesSpec, fill_forward
from tidewatch.sources import sinks


def _executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_chirp_filter_is_not_broadcast(spark):
    rows = spark.range(3000).select(F.lit("a").alias("s"), F.col("id").alias("pos"), F.lit(3000).alias("n"), F.sin("id").alias("v"))
    plan = _executed(fourier.any_length(rows, ["s"], "pos", "n", F.col("v")))
    assert "BroadcastHashJoin" not in plan.split("Initial Plan")[0]


def test_lines_come_in_batches(spark, monkeypatch):
    """Lines of several series and lengths, cut by batches of a few cells; a null key is a series."""
    monkeypatch.setattr(fourier, "CELLS", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = np.random.default_rng(3)
        series = {None: rng.normal(size=32), "a": rng.normal(size=32), "b": rng.normal(size=8), "": rng.normal(size=128)}
        cells = [(k, len(x), j, float(v), 0.0) for k, x in series.items() for j, v in enumerate(x)]
        rows = spark.createDataFrame(cells, f"s string, {fourier.M} long, {fourier.J} long, {fourier.RE} double, {fourier.IM} double")
        done = fourier.transform(rows, ["s"])
        got = done.toPandas()
        back = fourier.transform(done, ["s"], inverse=True).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, x in series.items():
        mine = got[got["s"].isna() if k is None else got["s"] == k].sort_values(fourier.J)
        np.testing.assert_allclose(mine[fourier.RE] + 1j * mine[fourier.IM], np.fft.fft(x), atol=1e-9)
        mine = back[back["s"].isna() if k is None else back["s"] == k].sort_values(fourier.J)
        np.testing.assert_allclose(mine[fourier.RE] / len(x), x, atol=1e-9)


def test_a_small_key_is_one_file(spark, tmp_path, monkeypatch):
    rows = spark.range(800, numPartitions=8).select((F.col("id") % 10).alias("k"), "id")
    sinks.write_by_key(rows, str(tmp_path / "small"), ["k"])
    assert len(list((tmp_path / "small").glob("k=*/*.parquet"))) == 10
    monkeypatch.setattr(sinks, "FILE_ROWS", 20)  # a large one is dealt
    sinks.write_by_key(rows, str(tmp_path / "large"), ["k"])
    assert len(list((tmp_path / "large").glob("k=*/*.parquet"))) > 10
    assert spark.read.parquet(str(tmp_path / "large")).count() == 800


def test_close_pairs_hold_the_nearest_and_their_ties():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 8)), np.repeat(rng.normal(size=(60, 8)), 3, axis=0)  # every row of y three times
    skip = rng.random((40, 180)) < 0.1
    want = np.where(skip, np.inf, neighbors._distances(x, y))
    qi, ti, dist = neighbors._close_pairs(x, y, 5, skip)
    assert (dist == want[qi, ti]).all()
    found = np.zeros(want.shape, bool)
    found[qi, ti] = True
    assert found[want <= np.sort(want, axis=1)[:, 4:5]].all()


def test_small_cells_share_a_group():
    centre = np.random.default_rng(2).normal(size=(100, 4))
    groups = neighbors._packed(centre, np.full(100, 50), 1000)
    assert groups.max() + 1 == 5 and np.bincount(groups).max() * 50 <= 1000
    assert len(set(neighbors._packed(centre, np.full(100, 1500), 1000))) == 100


def test_fills_read_written_rows(spark):
    rows = spark.range(50).select(F.lit("a").alias("s"), "id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    spec = SeriesSpec(("s",), ("id",), "v")
    out = fill_forward(rows, spec, {"f": F.col("v")}, block_rows=10)
    assert out.inputFiles()  # not the steps before it, once for the edges and once for the rows
    assert {r.id: r.f for r in out.collect()} == {i: i - i % 7 for i in range(50)}


def _few_events(spark, folder, n):
    t = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))
    value = F.when(F.col("id") % 9 == 0, 150.0).otherwise(F.col("id") % 50 + 0.5)
    rows = spark.range(n).select(
        F.col("id").alias("event_id"), t.alias("ts"), (F.col("id") % 3).alias("user_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type"),
        value.alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props"),
    )
    rows.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_rows_are_dealt_while_narrow(spark, tmp_path, monkeypatch):
    sf, seen = _few_events(spark, tmp_path, 700), []
    for module, name in ((split, "with_global_index"), (split, "hash_rank"), (balance, "hash_rank")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *a, _real=real, **kw: seen.append(df.columns) or _real(df, *a, **kw))
    model_queries.feature_rows(spark, sf)
    model_queries.semi_batches(spark, sf).collect()
    assert seen and all(len(c) <= 7 and "window" not in c and "value_w5_mean" not in c for c in seen)
    got = model_queries.semi_windows(spark, sf)
    assert got.count() == 700 - 2 * model_queries.HISTORY
    assert [r["count"] for r in got.groupBy("fold").count().orderBy("fold").collect()] == [80] * 5


def test_labels_of_negatives_need_no_rank(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") == 3, None).otherwise(0).alias("y"))
    got = split.hide_labels(rows, "y", ["id"], 0.75, out="shown")
    assert got.columns == ["id", "y", "shown"]
    assert got.where("shown = 1").count() == 25 and got.where("y IS NULL AND shown IS NULL").count() == 1 and got.count() == 1000


def test_only_used_statistics_and_histories_are_made(spark, tmp_path, monkeypatch):
    sf, kept, given = _few_events(spark, tmp_path, 4000), [], []
    real, real_windows = model_queries.written, model_queries.history_windows
    monkeypatch.setattr(model_queries, "written", lambda df: kept.append(df.columns) or real(df))
    monkeypatch.setattr(model_queries, "history_windows", lambda df, *a, **kw: given.append(df) or real_windows(df, *a, **kw))
    monkeypatch.setattr(model_queries.balance, "alternating_batch", lambda df, *a, **kw: df.where("place IN (1000, 1001) AND event_type = 'a'").withColumn("slot", F.col("place") % 2))
    model_queries.saved_detector(spark, sf).count()
    assert "value_w25_std" in kept[-1] and not {"value_w50_kurt", "value_w5_mean"} & set(kept[-1])
    hidden = []
    monkeypatch.setattr(split, "hash_rank", lambda df, *a, _real=split.hash_rank, **kw: hidden.append(df.columns) or _real(df, *a, **kw))
    model_queries.score_quality(spark, sf)
    assert hidden and all("value_w5_mean" not in c for c in hidden) and kept[-1] == ["is_anomaly", "score"]
    batches = model_queries.semi_batches(spark, sf).collect()
    assert sum(r.n for r in batches) == 2 and {r["size"] for r in batches} == {model_queries.HISTORY}
    assert given[-1].count() <= model_queries.HISTORY + 2


def test_feature_blocks_do_not_show(spark, tmp_path, monkeypatch):
    sf = _few_events(spark, tmp_path, 900)
    whole = sorted(model_queries.feature_rows(spark, sf).collect())
    monkeypatch.setattr(model_queries, "FEATURE_BLOCK", 100)
    assert sorted(model_queries.feature_rows(spark, sf).collect()) == whole
