"""Splits, folds and label hiding, all by exact positions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import hash_rank, with_global_index
from tidewatch.series import SeriesSpec, join_keys, series_stats, small


def ordered_split(df: DataFrame, spec: SeriesSpec, test_fraction: float = 0.3, **kw) -> DataFrame:
    """``split``: the last ceil(fraction * n) rows of the concatenated series are test."""
    stats = kw["stats"] = kw.get("stats") or series_stats(df, spec.series)
    rows = with_global_index(df, spec, "_idx", **kw)
    n = stats.n_rows
    train = n - math.ceil(test_fraction * n)
    return rows.withColumn("split", F.when(F.col("_idx") < train, "train").otherwise("test")).drop("_idx")


def stratified_split(df: DataFrame, label: str, ids: Sequence[str], test_fraction: float = 0.2, seed: int = 0, **kw) -> DataFrame:
    """``split`` with the same test share in every class (exact counts, reproducible)."""
    stats = series_stats(df, [label])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    rows = join_keys(hash_rank(df, [label], ids, seed, "_rank", **kw), small(sizes, stats.n_series), [label], "left")
    test = F.col("_rank") <= F.bround(F.col("_n") * F.lit(test_fraction), 0)
    return rows.withColumn("split", F.when(test, "test").otherwise("train")).drop("_rank", "_n")


def fold_of(position: Column, n: Column, k: int) -> Column:
    """Fold number of a position when n rows form k contiguous blocks, longer blocks first."""
    q, r = F.floor(n / k), n % k
    head = r * (q + 1)
    return F.when(position < head, F.floor(position / (q + 1))).otherwise(r + F.floor((position - head) / F.greatest(q, F.lit(1)))).cast("int")


def contiguous_folds(df: DataFrame, spec: SeriesSpec, k: int = 5, omit_last: bool = False, **kw) -> DataFrame:
    """``fold`` (0..k-1) and ``in_test``: with ``omit_last`` the last row of a block stays in train."""
    stats = kw["stats"] = kw.get("stats") or series_stats(df, spec.series)
    rows = with_global_index(df, spec, "_idx", **kw)
    n = F.lit(stats.n_rows)
    fold = fold_of(F.col("_idx"), n, k)
    following = fold_of(F.col("_idx") + 1, n, k)
    last = (F.col("_idx") == n - 1) | (fold != following)
    in_test = ~last if omit_last else F.lit(True)
    return rows.withColumns({"fold": fold, "in_test": in_test}).drop("_idx")


def stratified_series_folds(series: DataFrame, key: str, category: str, order: str, k: int = 5, **kw) -> DataFrame:
    """``fold`` per series so that every fold has its share of each category, without shuffling.

    Categories are ranked by first appearance.  In category order the series are dealt to the
    folds in turn; inside a category the dealt fold numbers are handed out in ascending order.
    """
    spec = SeriesSpec((category,), (order,), "")
    from tidewatch.series import POS, with_positions

    rows = with_positions(series, spec, **kw)
    sizes = series.groupBy(category).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    from tidewatch.operators.ordered import prefix_counts

    offsets = prefix_counts(sizes, ["_first", category], [category])
    rows = join_keys(rows, small(offsets, series_stats(series, [category]).n_series), [category], "left")
    rows = join_keys(rows, sizes.drop("_first"), [category], "left")
    start, end, j = F.col("_before"), F.col("_before") + F.col("_n"), F.col(POS)

    def dealt_up_to(fold: int) -> Column:
        # how many of the places start..end-1 fall to folds 0..fold
        total = None
        for f in range(fold + 1):
            c = F.floor((end - 1 - f) / k) - F.floor((start - 1 - f) / k)
            total = c if total is None else total + c
        return total

    fold = F.lit(k - 1)
    for f in range(k - 2, -1, -1):
        fold = F.when(j < dealt_up_to(f), f).otherwise(fold)
    return rows.withColumn("fold", fold.cast("int")).drop("_before", "_n", POS)


def window_split(df: DataFrame, index: str, total: int, train: float = 0.4, validation: float = 0.1) -> DataFrame:
    """40/10/50 split of ordered windows by index."""
    a, b = math.floor(train * total), math.floor((train + validation) * total)
    i = F.col(index)
    return df.withColumn("split", F.when(i < a, "train").when(i < b, "validation").otherwise("test"))


def normal_window_split(windows: DataFrame, spec: SeriesSpec, label: str = "window_label", train: float = 0.4, validation: float = 0.1, **kw) -> DataFrame:
    """40/10/50 split of the normal windows in the order of ``spec``; every other window is test.
    A missing label counts as normal."""
    from tidewatch.series import POS, with_positions

    attack = F.coalesce(F.col(label), F.lit(0)) != 0
    normal = windows.where(~attack)
    rows = window_split(with_positions(normal, spec, **kw), POS, normal.count(), train, validation)
    return rows.select(*windows.columns, "split").unionByName(windows.where(attack).withColumn("split", F.lit("test")))


def hide_labels(df: DataFrame, label: str, ids: Sequence[str], share: float = 0.75, seed: int = 0, out: str | None = None, **kw) -> DataFrame:
    """Set a random share of the positive labels to 0 (round half to even of share * positives)."""
    shown = out or label
    # only positives can lose their label: the other rows, most of the table, need no rank and stay where they are
    positives, others = df.where(F.col(label) == 1), df.where((F.col(label) != 1) | F.col(label).isNull())
    hidden = F.col("_rank") <= round(share * positives.count())
    ranked = hash_rank(positives, [label], ids, seed, "_rank", **kw).withColumn(shown, F.when(hidden, 0).otherwise(F.col(label)))
    return ranked.drop("_rank").unionByName(others.withColumn(shown, F.when(F.lit(False), 0).otherwise(F.col(label))))
