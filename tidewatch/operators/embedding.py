"""Sliding windows as arrays with a label at an offset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewatch.series import POS, TOTAL, SeriesSpec, over_series


def history_windows(
    df: DataFrame, spec: SeriesSpec, history: int, target: str | None = None, label_offset: int = 0,
    target_steps: int = 0, step: int = 1, label_steps: int | None = None, **kw,
) -> DataFrame:
    """The ``history`` rows before each row as ``window`` and ``label`` = target[i + label_offset].

    Rows i with history <= i < n - target_steps are kept.  ``step`` thins the window;
    ``label_steps`` gives the next so many targets as an array instead of one value.  A label
    outside the series drops the row.
    """
    target = target or spec.value

    def fn(rows: DataFrame, w: WindowSpec) -> DataFrame:
        past = F.collect_list(F.col(spec.value)).over(w.rowsBetween(-history, -1))
        if label_steps:
            label = F.collect_list(F.col(target)).over(w.rowsBetween(0, label_steps - 1))
        elif label_offset >= 0:
            label = F.lead(target, label_offset).over(w) if label_offset else F.col(target)
        else:
            label = F.lag(target, -label_offset).over(w)
        rows = rows.withColumns({"window": past, "label": label})
        rows = rows.where((F.col(POS) >= history) & (F.col(POS) < F.col(TOTAL) - target_steps) & F.col("label").isNotNull())
        if step > 1:
            rows = rows.withColumn("window", F.filter("window", lambda _, i: i % step == 0))
        return rows

    ahead = max(label_offset, label_steps or 0, 0)
    return over_series(df, spec, fn, before=max(history, -label_offset), after=ahead, totals=True, **kw)


def matrix_windows(df: DataFrame, spec: SeriesSpec, columns: Sequence[str], size: int, label: str | None = None, **kw) -> DataFrame:
    """Windows of ``size`` rows x columns starting at each row, as ``window`` (array of arrays),
    with ``label`` = 1 when any row inside is labelled.  n - size windows per series."""

    def fn(rows: DataFrame, w: WindowSpec) -> DataFrame:
        f = w.rowsBetween(0, size - 1)
        rows = rows.withColumn("_row", F.array(*[F.col(c).cast("double") for c in columns]))
        new = {"window": F.collect_list("_row").over(f)}
        if label:
            new["window_label"] = F.max(label).over(f)
        rows = rows.withColumns(new).drop("_row")
        return rows.where(F.col(POS) < F.col(TOTAL) - size).withColumn("window_index", F.col(POS))

    return over_series(df, spec, fn, after=size, totals=True, **kw)


def flat(df: DataFrame, window: str = "window", out: str = "vector") -> DataFrame:
    return df.withColumn(out, F.flatten(window))
