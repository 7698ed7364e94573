"""Row-frame expressions over an ordered series window.

"Full" means the trailing frame holds ``n`` non-null values; a statistic is NULL otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.functions.scalars import ENTROPY_SENTINEL, RATIO_SENTINEL, safe_ratio
from tidewatch.series import POS

# Window lengths and lags of the feature sets.
WINDOWS = (5, 25, 50)
LAGS = (1, 2, 3, 5, 10, 15)
RATIO_LAGS = (2, 3, 5, 10, 15)
RATIO_WINDOW = 10


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def when_full(x: Column, c: Column, w: WindowSpec, n: int) -> Column:
    return F.when(F.count(c).over(trailing(w, n)) == n, x)


def rolling_mean(c: Column, w: WindowSpec, n: int) -> Column:
    return when_full(F.avg(c).over(trailing(w, n)), c, w, n)


def rolling_std(c: Column, w: WindowSpec, n: int) -> Column:
    return when_full(F.stddev_samp(c).over(trailing(w, n)), c, w, n)


def unbiased_kurtosis(population: Column, n: int) -> Column:
    """Bias-corrected excess kurtosis from Spark's population excess kurtosis."""
    return ((n + 1) * population + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def with_references(df: DataFrame, w: WindowSpec, column: str, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Add, per window length, the value's distances from two references, for the power sums of its frames.

    Cut into runs of n rows, a frame of n rows lies in two neighbouring runs and always holds the first
    row of the later one.  That row's value is the frame's reference: no distance exceeds the frame's own
    range, so its power sums lose no digits.  As a run is the later or the earlier one of a frame, a row
    has the distance ``_e`` from the start of the even one of its own and the next run, and ``_o`` from
    that of the odd one.  Needs ``_pos``.
    """
    c, starts = F.col(column), {}
    for n in windows:
        first = F.when(F.col(POS) % n == 0, c)
        starts[f"_own{n}"] = F.last(first, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        starts[f"_next{n}"] = F.max(first).over(w.rowsBetween(1, n))
    rows = df.withColumns(starts)
    distances = {}
    for n in windows:
        own, following = c - F.col(f"_own{n}"), c - F.col(f"_next{n}")
        distances[f"_e{n}"] = F.when(even_run(n), own).otherwise(following)
        distances[f"_o{n}"] = F.when(even_run(n), following).otherwise(own)
    return rows.withColumns(distances).drop(*starts)


def even_run(n: int) -> Column:
    return F.col(POS) % (2 * n) < n


def frame_moments(sums: tuple[Column, ...], n: int) -> tuple[Column, Column]:
    """Sum of squares and of fourth powers around the mean of a frame, from the sums of the first four
    powers of the distances; exactly 0 when constant."""
    s1, s2, s3, s4 = sums
    m = s1 / n
    return s2 - m * s1, s4 - m * s3 * 4 + m * m * s2 * 6 - m * m * m * s1 * 3


def rolling_zscore(c: Column, w: WindowSpec, n: int) -> Column:
    f = trailing(w, n)
    return when_full(F.try_divide(c - F.avg(c).over(f), F.stddev_pop(c).over(f)), c, w, n)


def entropy_term(c: Column) -> Column:
    return F.when(c == 0, 0.0).otherwise(F.abs(c) * F.ln(F.abs(c)))


def entropy_from_sums(total: Column, terms: Column, low: Column, high: Column) -> Column:
    """-sum(p ln p), p = x / sum(x); the sentinel when a share is negative or the sum is zero."""
    one_sign = (low >= 0) | (high <= 0)
    h = F.ln(F.abs(total)) - F.try_divide(terms, F.abs(total))
    return F.when(one_sign & (total != 0), h).otherwise(F.lit(ENTROPY_SENTINEL))


def rolling_entropy(c: Column, w: WindowSpec, n: int) -> Column:
    f = trailing(w, n)
    h = entropy_from_sums(
        F.sum(c).over(f), F.sum(entropy_term(c)).over(f), F.min(c).over(f), F.max(c).over(f)
    )
    return when_full(h, c, w, n)


def lag_or_zero(c: Column, w: WindowSpec, i: int) -> Column:
    return F.coalesce(F.lag(c, i).over(w), F.lit(0.0))


def step_difference(c: Column, w: WindowSpec) -> Column:
    """c[i] - c[i-1]; 0 on the first two rows."""
    return F.when(F.col(POS) > 1, c - F.lag(c, 1).over(w)).otherwise(F.lit(0.0))


def step_ratio(c: Column, w: WindowSpec) -> Column:
    """c[i] / c[i-1]; the sentinel on the first two rows and when c[i-1] is not positive."""
    prev = F.lag(c, 1).over(w)
    return F.when((F.col(POS) > 1) & (prev > 0), F.try_divide(c, prev)).otherwise(F.lit(RATIO_SENTINEL))


def ratio_to_own_mean(c: Column, w: WindowSpec, n: int = RATIO_WINDOW) -> Column:
    return safe_ratio(c, rolling_mean(c, w, n))


def base_stat_windows(column: str, w: WindowSpec, windows: tuple[int, ...] = WINDOWS) -> dict[str, Column]:
    """Raw frame aggregates behind mean, std, kurt, zscore and entropy, keyed by helper name.

    Needs the columns of ``with_references``.

    Unused ones are pruned by the optimizer; all frames share one (partition, order), so they run
    in one pass over one sort.
    """
    c = F.col(column)
    raw: dict[str, Column] = {}
    for n in windows:
        f = trailing(w, n)
        raw[f"_c{n}"] = F.count(c).over(f)
        raw[f"_m{n}"] = F.avg(c).over(f)
        for side in "eo":
            y = power = F.col(f"_{side}{n}")
            for k in range(1, 5):
                raw[f"_{side}{n}_{k}"] = F.sum(power).over(f)
                power = power * y
        raw[f"_h{n}"] = F.sum(entropy_term(c)).over(f)
        raw[f"_lo{n}"] = F.min(c).over(f)
        raw[f"_hi{n}"] = F.max(c).over(f)
    return raw


def base_stats(
    column: str, prefix: str = "", fallback: bool = True, windows: tuple[int, ...] = WINDOWS, entropy: bool = True
) -> dict[str, Column]:
    """mean, std, kurt, zscore (and entropy) per window length, as ``{prefix}value_w{n}_{stat}``.

    Reads the columns of ``base_stat_windows``.  With ``fallback`` a value that is missing for
    ``n`` is taken from the next shorter window, and for the shortest window from the row value
    (mean) or 0 (others).
    """
    c = F.col(column)
    shorter = {"mean": c, "std": F.lit(0.0), "kurt": F.lit(0.0), "zscore": F.lit(0.0), "entropy": F.lit(0.0)}
    chain: dict[str, list[Column]] = {k: [x] for k, x in shorter.items()}
    out: dict[str, Column] = {}
    for n in windows:
        full = F.col(f"_c{n}") == n
        mean = F.col(f"_m{n}")
        sums = tuple(F.when(even_run(n), F.col(f"_e{n}_{k}")).otherwise(F.col(f"_o{n}_{k}")) for k in range(1, 5))
        squares, fourths = frame_moments(sums, n)
        squares = F.greatest(squares, F.lit(0.0))
        own = F.when(even_run(n), F.col(f"_e{n}")).otherwise(F.col(f"_o{n}"))
        now = {
            "mean": mean,
            "std": F.sqrt(squares / (n - 1)),
            "kurt": unbiased_kurtosis(F.try_divide(fourths * n, squares * squares) - 3, n),
            "zscore": F.try_divide(own - sums[0] / n, F.sqrt(squares / n)),
        }
        if entropy:
            now["entropy"] = entropy_from_sums(mean * n, F.col(f"_h{n}"), F.col(f"_lo{n}"), F.col(f"_hi{n}"))
        for stat, x in now.items():
            chain[stat].insert(0, F.when(full, x))
            out[f"{prefix}value_w{n}_{stat}"] = F.coalesce(*chain[stat]) if fallback else chain[stat][0]
    return out


def helper_names(windows: tuple[int, ...] = WINDOWS) -> list[str]:
    plain = [f"_{k}{n}" for n in windows for k in ("c", "m", "h", "lo", "hi", "e", "o")]
    return plain + [f"_{side}{n}_{k}" for n in windows for side in "eo" for k in range(1, 5)]
