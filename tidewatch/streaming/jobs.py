"""Streaming forms: deduplicated ingest, tumbling means, scoring, rolling features."""

from __future__ import annotations

import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.operators.detect import ClusterDetector
from tidewatch.sources.tables import STATS_SCHEMA, stats_samples

WATERMARK = "10 minutes"


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Container samples as they arrive in a folder of JSON files."""
    return stats_samples(spark.readStream.schema(f"container STRING, {STATS_SCHEMA}").json(path))


def unique_samples(
    df: DataFrame, keys: Sequence[str] = ("container", "timestamp"), time: str = "timestamp", delay: str | None = None
) -> DataFrame:
    """Each (container, timestamp) once, however the input is dealt to micro-batches: every key stays
    in the state.  With ``delay`` the state is bounded and rows behind the watermark are dropped."""
    if delay is None:
        return df.dropDuplicates(list(keys))
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def append_to_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> StreamingQuery:
    return (
        df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).outputMode("append").start()
    )


def nearest_window(time: str, seconds: int) -> Column:
    """Windows shifted by half their width: a sample belongs to the nearest multiple (a tie goes up)."""
    return F.window(time, f"{seconds} seconds", startTime=f"{int(seconds * 500)} milliseconds")


def window_centre(window: str, seconds: int) -> Column:
    return F.col(f"{window}.start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds / 2).cast("decimal(18,6)"))


def tumbling_means(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str], time: str = "timestamp", seconds: int = 10, delay: str = WATERMARK
) -> DataFrame:
    """Mean per key and rounded time for a stream without end: a window is emitted once, when the
    watermark has passed it, and rows behind the watermark are dropped.  ``append_tumbling_sums``
    drops none."""
    rows = df.withWatermark(time, delay).groupBy(nearest_window(time, seconds).alias("w"), *keys)
    out = rows.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])
    return out.select(*keys, window_centre("w", seconds).alias("datetime"), *[f"{c}_mean" for c in columns])


def append_tumbling_sums(
    df: DataFrame, path: str, checkpoint: str, columns: Sequence[str], keys: Sequence[str], time: str = "timestamp", seconds: int = 10
) -> StreamingQuery:
    """Sums and counts per key, rounded time and micro-batch, one folder per micro-batch.

    No row is late and no window waits; a micro-batch that runs again overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy(nearest_window(time, seconds).alias("w"), *keys).agg(
            *[F.sum(F.col(c).cast("double")).alias(f"{c}_sum") for c in columns], *[F.count(c).alias(f"{c}_n") for c in columns]
        )
        rows = sums.withColumn("datetime", window_centre("w", seconds)).drop("w")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def means_so_far(sums: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Mean per key and rounded time over all micro-batches that ``append_tumbling_sums`` wrote."""
    return sums.groupBy(*keys, "datetime").agg(*[F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(f"{c}_mean") for c in columns])


def score_stream(df: DataFrame, detector: ClusterDetector) -> DataFrame:
    """Stateless scoring: the fitted centres and boundaries are literals in the plan."""
    return detector.transform(df)


class RollingState(StatefulProcessor):
    """Keeps a series in order; emits rolling mean, std, kurt, zscore and entropy per row.

    Rows may come in any order over any number of micro-batches.  The state holds the series as sorted
    segments of about ``segment`` rows and an index of them, so a row is put in its place by
    reading one segment.  A late row changes the windows of the rows behind it: those are emitted again,
    with a higher ``version`` (``latest_features`` keeps the last).  A micro-batch is taken in the
    bounded chunks it arrives in.  With ``keep`` only about that many rows of a series (the newest) stay in
    the state; what a later row can't see any more is then missing from its windows.
    """

    def __init__(self, windows: tuple[int, ...] = (5, 25, 50), segment: int = 1_000, keep: int | None = None):
        self.windows, self.segment, self.keep = windows, max(segment, max(windows)), keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.index = handle.getValueState("index", "version long, next long, ids array<long>, ts array<long>, event array<long>")
        self.rows = handle.getMapState("rows", "segment long", "ts array<long>, event array<long>, value array<double>")

    def load(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ts, event, value = self.rows.getValue((number,))
        return np.array(ts, np.int64), np.array(event, np.int64), np.array([np.nan if v is None else v for v in value], float)

    def save(self, number: int, ts: np.ndarray, event: np.ndarray, value: np.ndarray) -> None:
        self.rows.updateValue((number,), (ts.tolist(), event.tolist(), value.tolist()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for chunk in rows:
            if len(chunk):
                yield from self.taken(key[0], chunk)

    def taken(self, series: str, chunk: pd.DataFrame) -> Iterator[pd.DataFrame]:
        longest = max(self.windows)
        ts, event = chunk["ts"].to_numpy().astype("datetime64[us]").astype(np.int64), chunk["event_id"].to_numpy(np.int64)
        order = np.lexsort((event, ts))
        ts, event, value = ts[order], event[order], chunk["value"].to_numpy(float)[order]
        version, new, ids, first_ts, first_event = (list(v) if isinstance(v, (list, tuple, np.ndarray)) else v for v in (self.index.get() if self.index.exists() else (0, 0, [], [], [])))
        # the segment of every row: the last that starts at or before it
        starts = list(zip(first_ts, first_event, strict=True))
        place = np.array([max(0, bisect.bisect_right(starts, k) - 1) for k in zip(ts.tolist(), event.tolist(), strict=True)])
        if not ids:
            ids, new = [0], 1
            self.save(0, *(np.zeros(0, t) for t in (np.int64, np.int64, float)))
        held: dict[int, tuple] = {}
        asked: dict[int, tuple[int, int]] = {}  # the rows to emit, by segment
        for i in np.unique(place).tolist():
            mine = place == i
            have = self.load(ids[i])
            merged = [np.concatenate([x, y[mine]]) for x, y in zip(have, (ts, event, value), strict=True)]
            by = np.lexsort((merged[1], merged[0]))
            held[i] = tuple(x[by] for x in merged)
            fresh = np.flatnonzero(by >= len(have[0]))
            asked[i] = int(fresh[0]), int(fresh[-1]) + longest
        for i in range(len(ids)):  # windows that reach into the next segment
            if i in asked:
                if i not in held:
                    held[i] = self.load(ids[i])
                lo, hi = asked[i]
                if (over := hi - len(held[i][0])) > 0 and i + 1 < len(ids):
                    a, b = asked.get(i + 1, (0, 0))
                    asked[i + 1] = 0, max(b, over)
        version += 1
        for i in sorted(asked):
            lo, hi = asked[i]
            t, e, v = held[i]
            hi = min(hi, len(t))
            if lo < hi:
                past, j = v[max(0, lo - longest + 1) : lo], i - 1
                while len(past) < longest - 1 and j >= 0:
                    earlier = (held[j] if j in held else self.load(ids[j]))[2]
                    past = np.concatenate([earlier[max(0, len(earlier) - (longest - 1 - len(past))) :], past])
                    j -= 1
                stats = rolling_block(np.concatenate([past, v[lo:hi]]), self.windows)
                out = {"series": [series] * (hi - lo), "event_id": e[lo:hi], "ts": t[lo:hi].astype("datetime64[us]"), "version": [version] * (hi - lo)}
                yield pd.DataFrame(out | {k: x[len(past) :] for k, x in stats.items()})
        # store, in segments of bounded size
        table = list(zip(ids, first_ts or [0], first_event or [0], strict=True))
        for i in sorted(held, reverse=True):
            t, e, v = held[i]
            parts = np.array_split(np.arange(len(t)), max(1, len(t) // self.segment)) if len(t) > 2 * self.segment else [np.arange(len(t))]
            numbers = [ids[i], *range(new, new + len(parts) - 1)]
            new += len(parts) - 1
            for number, part in zip(numbers, parts, strict=True):
                self.save(number, t[part], e[part], v[part])
            table[i : i + 1] = [(number, int(t[part[0]]), int(e[part[0]])) for number, part in zip(numbers, parts, strict=True)]
        if self.keep is not None:
            while len(table) > 1 + -(-self.keep // self.segment) + 1:
                self.rows.removeKey((table.pop(0)[0],))
        self.index.update((version, new, [x[0] for x in table], [x[1] for x in table], [x[2] for x in table]))

    def close(self) -> None:
        pass


def rolling_block(values: np.ndarray, windows: Sequence[int]) -> dict[str, np.ndarray]:
    """The fallback statistics for one ordered run of values; a window with a missing value (NaN) is
    not full, as in batch."""
    n = len(values)
    out: dict[str, np.ndarray] = {}
    last = {"mean": values.copy(), "std": np.zeros(n), "kurt": np.zeros(n), "zscore": np.zeros(n), "entropy": np.zeros(n)}
    for w in windows:
        now = {k: v.copy() for k, v in last.items()}
        if n >= w:
            x = np.lib.stride_tricks.sliding_window_view(values, w)
            full = ~np.isnan(x).any(axis=1)
            x = np.where(full[:, None], x, 0.0)
            mean = x.mean(axis=1)
            d = x - mean[:, None]
            var = (d**2).mean(axis=1)
            varied = var > 0
            safe = np.where(varied, var, 1.0)
            kurt = ((w + 1) * ((d**4).mean(axis=1) / safe**2 - 3) + 6) * (w - 1) / ((w - 2) * (w - 3))
            z = d[:, -1] / np.sqrt(safe)
            total = x.sum(axis=1)
            size = np.abs(x)
            terms = np.where(size > 0, size * np.log(np.where(size > 0, size, 1.0)), 0.0).sum(axis=1)
            one_sign = ((x >= 0).all(axis=1) | (x <= 0).all(axis=1)) & (total != 0)
            scale = np.where(one_sign, np.abs(total), 1.0)
            entropy = np.where(one_sign, np.log(scale) - terms / scale, 10000.0)
            at = slice(w - 1, n)
            found = {"mean": (full, mean), "std": (full, np.sqrt(var * w / (w - 1))), "entropy": (full, entropy)}
            found |= {"kurt": (full & varied, kurt), "zscore": (full & varied, z)}
            for k, (valid, v) in found.items():
                now[k][at] = np.where(valid, v, now[k][at])
        out.update({f"value_w{w}_{k}": v for k, v in now.items()})
        last = now
    return out


def rolling_features(df: DataFrame, key: str, windows: tuple[int, ...] = (5, 25, 50), segment: int = 1_000, keep: int | None = None) -> DataFrame:
    """Rolling statistics on a stream of (key, ts, event_id, value) in any order, with a version:
    ``latest_features`` of all rows so far equals the batch features of all rows so far."""
    names = [f"value_w{w}_{s} double" for w in windows for s in ("mean", "std", "kurt", "zscore", "entropy")]
    schema = "series string, event_id long, ts timestamp, version long, " + ", ".join(names)
    return (
        df.groupBy(key)
        .transformWithStateInPandas(RollingState(windows, segment, keep), outputStructType=schema, outputMode="Append", timeMode="None")
    )


def latest_features(emitted: DataFrame) -> DataFrame:
    """The last version of every row that ``rolling_features`` emitted (event ids are unique in a series)."""
    rest = [c for c in emitted.columns if c not in ("series", "event_id", "version")]
    last = emitted.groupBy("series", "event_id").agg(F.max_by(F.struct(*rest), "version").alias("_r"))
    return last.select("series", "event_id", *[F.col(f"_r.{c}").alias(c) for c in rest])
