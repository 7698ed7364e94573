"""Sources, sinks, saved models and streaming forms."""

import json

import numpy as np
import pandas as pd
import pytest
from helpers import SPEC, make_series
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidewatch.operators import evaluate, features, models
from tidewatch.operators.detect import ClusterDetector
from tidewatch.operators.split import ordered_split
from tidewatch.series import SeriesSpec
from tidewatch.sources import sinks, tables
from tidewatch.streaming import jobs


def test_series_files(spark, tmp_path):
    for name in ("real_2", "real_10"):
        pd.DataFrame({"timestamp": [1, 2], "value": [0.5, 1.5], "is_anomaly": [0, 1]}).to_csv(tmp_path / f"{name}.csv", index=False)
    rows = tables.read_series(spark, str(tmp_path))
    assert sorted({r["series_id"] for r in rows.collect()}) == ["real_10", "real_2"]
    picked = tables.select_series(rows, ["real_10"]).collect()
    assert len(picked) == 2 and picked[0]["series_pos"] == 0


def test_app_files_carry_the_key_in_their_name(spark, tmp_path):
    (tmp_path / "obs1|v-2.csv").write_text("timestamp,avg_response_time,throughput,http_error_count,service_error_count\n2020-06-16 10:00:00,1.5,,0,1\n")
    schema = tables.APP_SCHEMA.replace(", is_anomaly INT", "")
    r = tables.read_app_series(spark, str(tmp_path), schema).first()
    assert (r["app_id"], r["version"], r["throughput"], r["service_error_count"]) == ("obs1", "v-2", None, 1.0)


def test_semicolons_and_decimal_commas(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;label\n1,5;Normal\nbad;A ttack\n")
    rows = tables.decimal_columns(tables.read_csv(spark, str(tmp_path), "x STRING, label STRING", sep=";"), ["x"])
    assert [r["x"] for r in rows.collect()] == [1.5, None]


def test_matrix_and_labels_line_up_over_splits(spark, tmp_path):
    n = 3000
    for m in ("machine-1", "machine-2"):
        (tmp_path / "x").mkdir(exist_ok=True)
        (tmp_path / "y").mkdir(exist_ok=True)
        (tmp_path / "x" / f"{m}.txt").write_text("\n".join(f"{i},{i * 0.5}" for i in range(n)) + "\n\n")
        (tmp_path / "y" / f"{m}.txt").write_text("\n".join(str(i % 7 == 0).replace("True", "1").replace("False", "0") for i in range(n)) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        x = tables.read_matrix(spark, str(tmp_path / "x"), ["col1", "col2"])
        y = tables.read_labels(spark, str(tmp_path / "y"))
        assert tables.line_positions(spark, str(tmp_path / "x")).rdd.getNumPartitions() > 2
        got = tables.attach_labels(x, y)
        assert got.count() == 2 * n
        assert got.where("row_idx != CAST(col1 AS INT) OR label != IF(row_idx % 7 = 0, 1, 0)").count() == 0
        with pytest.raises(Exception, match="do not line up"):
            tables.attach_labels(x, y.where("row_idx < 10")).select("machine_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_machines_of_one_name_in_two_folders(spark, tmp_path):
    for folder in ("train", "test"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "machine-1.txt").write_text("1,nan\n2,5\n3,6\n")
    rows = tables.read_matrix(spark, str(tmp_path), ["a", "b"]).collect()
    assert sorted((r["folder"], r["machine_id"], r["row_idx"], r["a"], r["b"] or 0.0) for r in rows) == [
        (f, "machine-1", i, i + 1.0, b) for f in ("test", "train") for i, b in enumerate([0.0, 5.0, 6.0])
    ]
    assert all(r["b"] is None for r in rows if r["row_idx"] == 0)


def test_ridge_solves_the_normal_equations(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2)) * [1.0, 4.0] + [0.5, 2.0]
    y = (x[:, 0] + 0.1 * x[:, 1] + rng.normal(size=600) > 1).astype(int)
    rows = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "is_anomaly": y}))
    for balance in (None, "weight"):
        w = np.where(y == 1, (1 - y).sum() / y.sum(), 1.0) if balance else np.ones(len(y))
        fitted = models.fit("ridge", rows, ["a", "b"], balance, strength=7.0).stages[-1]
        c = x - (w[:, None] * x).sum(0) / w.sum()
        s = (2 * y - 1) - (w * (2 * y - 1)).sum() / w.sum()
        want = np.linalg.solve(c.T @ (w[:, None] * c) + 7.0 * np.eye(2), c.T @ (w * s))
        assert np.allclose(fitted.coefficients.toArray(), want, rtol=1e-6)


def test_sinks(spark, tmp_path):
    pdf = make_series(0, sizes=(20, 10))
    rows = ordered_split(spark.createDataFrame(pdf), SPEC)
    sinks.write_csv(rows.select("s", "t", "i", "value"), str(tmp_path / "csv"), SPEC)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns[0] == "index" and sorted(int(r["index"]) for r in back.collect()) == list(range(30))
    sinks.write_split(rows, str(tmp_path / "split"), "y", "p")
    saved = spark.read.parquet(str(tmp_path / "split"))
    assert {"target", "predict", "split"} <= set(saved.columns) and saved.where("split = 'test'").count() == 9
    sinks.write_by_key(rows, str(tmp_path / "keys"), ["s"])
    assert spark.read.parquet(str(tmp_path / "keys")).groupBy("s").count().count() == 2
    sinks.write_json_lines(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 30
    summary = spark.createDataFrame([("raw", "auc", 0.5, 0.1), ("cut", "auc", 0.25, 0.0)], "g string, m string, a double, sd double")
    sinks.write_report(evaluate.metric_report(summary, "g", "m", "a", "sd"), str(tmp_path / "report"))
    text = next((tmp_path / "report").glob("*.json")).read_text()
    assert json.loads(text)["report"] == {"raw": {"auc": {"avg": 0.5, "std": 0.1}}, "cut": {"auc": {"avg": 0.25, "std": 0.0}}}


def test_model_reload_gives_equal_scores(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    rows = spark.createDataFrame(pd.DataFrame({"a": x, "b": rng.normal(size=400), "is_anomaly": (x > 1).astype(int)}))
    for name in ("deep_boosted_trees", "ridge"):
        model = models.fit(name, rows, ["a", "b"])
        model.write().overwrite().save(str(tmp_path / name))
        back = PipelineModel.load(str(tmp_path / name))
        a = models.score(model, rows, ["a", "b"]).toPandas().sort_values("a")["score"]
        b = models.score(back, rows, ["a", "b"]).toPandas().sort_values("a")["score"]
        assert np.allclose(a, b)
        assert evaluate.roc_auc(models.score(model, rows, ["a", "b"]), "is_anomaly", "score").first()[0] > 0.9


def test_unique_samples_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def sample(ts, cpu):
        return json.dumps({"container": "c", "timestamp": ts, "cpu": {"usage": {"total": cpu}}, "memory": {"working_set": 5}})

    (src / "a.json").write_text("\n".join([sample("2024-01-01T00:00:00", 1), sample("2024-01-01T00:00:01", 2)]))
    (src / "b.json").write_text("\n".join([sample("2024-01-01T00:00:01", 2), sample("2024-01-01T00:00:02", 3)]))
    rows = jobs.unique_samples(jobs.read_stats(spark, str(src)))
    jobs.append_to_files(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.schema("container string, timestamp timestamp, cpu_usage long, memory_usage long").json(str(tmp_path / "out"))
    assert sorted(r["cpu_usage"] for r in got.collect()) == [1, 2, 3]


def run_memory(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)


def test_tumbling_means_round_to_the_nearest_step(spark, tmp_path):
    pdf = pd.DataFrame({"k": "a", "s": [0, 4, 6, 14, 16, 5000], "v": [1.0, 3.0, 5.0, 7.0, 9.0, 0.0]})
    spark.createDataFrame(pdf).withColumn("timestamp", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("k string, v double, timestamp timestamp").parquet(str(tmp_path / "in"))
    run_memory(jobs.tumbling_means(src, ["v"], ["k"], delay="1 minute"), "tumble")
    got = {int(r["datetime"].timestamp()): r["v_mean"] for r in spark.table("tumble").select(F.col("datetime"), "v_mean").collect()}
    assert got == {0: 2.0, 10: 6.0, 20: 9.0}


@pytest.mark.parametrize("files", [1, 1000])
def test_streams_keep_late_rows_and_last_windows(spark, tmp_path, files):
    src = tmp_path / "in"
    for at, v in [("05:00", 1.0), ("03:00", 2.0), ("01:00", 3.0), ("03:00", 4.0)]:  # the times run backwards
        spark.createDataFrame([("a", f"2024-01-01 {at}:00", v)], "k string, t string, v double").select(
            "k", F.to_timestamp("t").alias("timestamp"), "v"
        ).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("k string, timestamp timestamp, v double").option("maxFilesPerTrigger", files).parquet(str(src))
    unique = jobs.unique_samples(stream, ("k", "timestamp"))
    jobs.append_to_files(unique, str(tmp_path / "u"), str(tmp_path / "uc"), "parquet").awaitTermination(180)
    assert spark.read.schema(unique.schema).parquet(str(tmp_path / "u")).count() == 3
    jobs.append_tumbling_sums(stream, str(tmp_path / "m"), str(tmp_path / "mc"), ["v"], ["k"], seconds=3600).awaitTermination(180)
    got = jobs.means_so_far(spark.read.parquet(str(tmp_path / "m")), ["v"], ["k"])
    assert {r["datetime"].hour: r["v_mean"] for r in got.collect()} == {1: 3.0, 3: 3.0, 5: 1.0}


def test_rolling_block_treats_missing_values_as_batch(spark):
    pdf = make_series(9, sizes=(90,), zeros=False)
    pdf.loc[[20, 41], "value"] = np.nan
    rows = spark.createDataFrame(pdf).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    want = features.cluster_features(rows, SeriesSpec(("s",), ("t", "i"))).toPandas().sort_values("i")
    for name, got in jobs.rolling_block(pdf["value"].to_numpy(float), (5, 25, 50)).items():
        assert np.allclose(got, want[name].to_numpy(float), atol=1e-6, equal_nan=True), name


def test_stream_scoring_equals_batch(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 17).cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    d = ClusterDetector(["value"], [[2.0], [12.0]], [1.5, 3.0])
    run_memory(jobs.score_stream(spark.readStream.schema("value double").parquet(str(tmp_path / "in")), d), "scored")
    assert spark.table("scored").exceptAll(d.transform(spark.read.parquet(str(tmp_path / "in")))).count() == 0
    assert spark.table("scored").count() == 100


def test_stream_rolling_features_equal_batch(spark, tmp_path):
    pdf = make_series(8, sizes=(120, 30), zeros=False)
    spec = SeriesSpec(("event_type",), ("ts", "event_id"))
    rows = spark.createDataFrame(pdf).select(
        F.col("s").alias("event_type"), F.timestamp_seconds("t").alias("ts"), F.col("i").cast("long").alias("event_id"), "value"
    )
    first, second = rows.where("ts < timestamp_seconds(600)"), rows.where("ts >= timestamp_seconds(600)")
    src = tmp_path / "in"
    first.coalesce(1).write.mode("append").parquet(str(src))
    schema = "event_type string, ts timestamp, event_id long, value double"
    stream = spark.readStream.schema(schema).parquet(str(src))
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = str(tmp_path / "out")
        for part in (None, second):
            if part is not None:
                part.coalesce(1).write.mode("append").parquet(str(src))
            q = (
                jobs.rolling_features(stream, "event_type").writeStream.format("parquet").option("path", out)
                .option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            )
            q.awaitTermination(180)
        got = jobs.latest_features(spark.read.parquet(out)).toPandas().sort_values("event_id").reset_index(drop=True)
    finally:
        spark.conf.set(conf, before)
    want = features.cluster_features(rows, spec).toPandas().sort_values("event_id").reset_index(drop=True)
    names = [c for c in got.columns if c.startswith("value_w")]
    assert len(got) == len(want)
    assert np.allclose(got[names].to_numpy(float), want[names].to_numpy(float), atol=1e-6)


@pytest.mark.parametrize("files,per_batch", [(1, 1), (50, 7)])
def test_late_rows_over_several_batches(spark, tmp_path, files, per_batch):
    """Rows dealt to files without regard to time: the last versions equal batch."""
    pdf = make_series(4, sizes=(260, 40, 1), zeros=False)
    rows = spark.createDataFrame(pdf).select(
        F.col("s").alias("event_type"), F.timestamp_seconds("t").alias("ts"), F.col("i").cast("long").alias("event_id"), "value"
    )
    src = str(tmp_path / "in")
    rows.repartition(files, F.xxhash64("event_id")).write.parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(src)
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        emitted = jobs.rolling_features(stream, "event_type", segment=60)
        jobs.append_to_files(emitted, str(tmp_path / "out"), str(tmp_path / "cp"), "parquet").awaitTermination(240)
    finally:
        spark.conf.set(conf, before)
    got = jobs.latest_features(spark.read.parquet(str(tmp_path / "out"))).toPandas().sort_values("event_id").reset_index(drop=True)
    want = features.cluster_features(rows, SeriesSpec(("event_type",), ("ts", "event_id"))).toPandas().sort_values("event_id").reset_index(drop=True)
    names = [c for c in got.columns if c.startswith("value_w")]
    assert got["event_id"].tolist() == want["event_id"].tolist()
    assert np.allclose(got[names].to_numpy(float), want[names].to_numpy(float), atol=1e-6)


class Cell:
    """A state variable in memory."""

    def __init__(self):
        self.held, self.most = {}, 0

    exists = lambda self: () in self.held
    get = lambda self: self.held[()]
    getValue = lambda self, k: self.held[k]

    def update(self, v):
        self.held[()] = v

    def updateValue(self, k, v):
        self.held[k] = v
        self.most = max(self.most, len(v[0]))

    def removeKey(self, k):
        del self.held[k]


class Handle:
    getValueState = lambda self, name, schema: Cell()
    getMapState = lambda self, name, key, value: Cell()


@pytest.mark.parametrize("seed,chunk", [(1, 1), (2, 13), (3, 400), (4, 1000)])
def test_rolling_state_in_any_order(seed, chunk):
    rng = np.random.default_rng(seed)
    n = 900
    ts = np.sort(rng.integers(0, 500, n)) * 1_000_000  # ties in time
    value = rng.standard_normal(n).round(2)
    value[rng.random(n) < 0.02] = np.nan
    want = jobs.rolling_block(value, (5, 25, 50))
    state = jobs.RollingState((5, 25, 50), segment=70)
    state.init(Handle())
    order = rng.permutation(n) if seed % 2 else np.argsort(ts + rng.integers(0, 30_000_000, n), kind="stable")
    last = {}
    for a in range(0, n, chunk):
        part = order[a : a + chunk]
        frame = pd.DataFrame({"ts": ts[part].astype("datetime64[us]"), "event_id": part, "value": value[part]})
        for out in state.handleInputRows(("k",), iter([frame]), None):
            for r in out.to_dict("records"):
                assert r["version"] > last.get(r["event_id"], {"version": 0})["version"]
                last[r["event_id"]] = r
    assert len(last) == n and state.rows.most <= 140 + min(chunk, n)
    assert max(len(v[0]) for v in state.rows.held.values()) <= 140
    for name, v in want.items():
        assert np.allclose([last[i][name] for i in range(n)], v, atol=1e-9, equal_nan=True), name


def test_rolling_state_is_bounded_with_keep():
    state = jobs.RollingState((5,), segment=50, keep=100)
    state.init(Handle())
    for a in range(0, 2_000, 40):
        frame = pd.DataFrame({"ts": np.arange(a, a + 40).astype("datetime64[us]"), "event_id": np.arange(a, a + 40), "value": np.arange(a, a + 40.0)})
        [out] = state.handleInputRows(("k",), iter([frame]), None)
        assert out["value_w5_mean"].iloc[-1] == a + 37
    assert sum(len(v[0]) for v in state.rows.held.values()) <= 400
