"""Column helpers: guards, sentinels, thresholds, parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentinels of the feature algebra.
RATIO_SENTINEL = 1000.0
ENTROPY_SENTINEL = 10000.0
ZERO_GUARD = 0.01
# Points per outcome (true positive, true negative, false positive, false negative).
OUTCOME_SCORES = {"tp": 5, "tn": 0, "fp": -3, "fn": -6}


def clean(c: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.nanvl(c, F.lit(None).cast("double"))


def safe_ratio(a: Column, b: Column, sentinel: float = RATIO_SENTINEL) -> Column:
    return F.when(b.isNull() | (b == 0), F.lit(sentinel)).otherwise(F.try_divide(a, b))


def zero_guard(c: Column, guard: float = ZERO_GUARD) -> Column:
    return F.when(c == 0, F.lit(guard)).otherwise(c)


def finite_or(c: Column, sentinel: float) -> Column:
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(sentinel)).otherwise(c)


def above(score: Column, threshold: float | Column) -> Column:
    return F.when(score > threshold, 1).otherwise(0)


def round_flag(score: Column) -> Column:
    """0/1 by rounding, ties to even (0.5 -> 0, 1.5 -> 2)."""
    return F.bround(score, 0).cast("int")


def magnitude_flag(score: Column, threshold: float = 1.96) -> Column:
    return F.when(F.abs(score) >= threshold, 1).otherwise(0)


def attack_flag(label: Column, word: str = "Attack") -> Column:
    """1 for the attack word, also when blanks were inserted inside it."""
    return F.when(F.regexp_replace(label, " ", "") == word, 1).otherwise(0)


def decimal_comma(text: Column) -> Column:
    return F.regexp_replace(text.cast("string"), ",", ".").try_cast("double")


def to_number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def outcome(actual: Column, predicted: Column) -> Column:
    return (
        F.when((actual == 1) & (predicted == 1), "tp")
        .when((actual == 0) & (predicted == 1), "fp")
        .when((actual == 1) & (predicted == 0), "fn")
        .otherwise("tn")
    )


def outcome_score(actual: Column, predicted: Column) -> Column:
    kind = outcome(actual, predicted)
    out = None
    for name, points in OUTCOME_SCORES.items():
        out = F.when(kind == name, points) if out is None else out.when(kind == name, points)
    return out


def outcome_columns(df: DataFrame, value: str, actual: str, predicted: str, off: float = -0.5) -> DataFrame:
    """Columns ``tp fp fn``: the value where the outcome holds, else ``off`` (plot data)."""
    kind = outcome(F.col(actual), F.col(predicted))
    return df.withColumns({k: F.when(kind == k, F.col(value)).otherwise(F.lit(off)) for k in ("tp", "fp", "fn")})


def day_index_to_date(i: Column, origin: str = "2020-01-01") -> Column:
    return F.date_add(F.lit(origin).cast("date"), i.cast("int"))


def cross_category(a: Column, b: Column) -> Column:
    return F.concat(a.cast("string"), b.cast("string"))


def split_range(text: Column) -> tuple[Column, Column]:
    """``"min-max"`` to two numbers; either side may be negative."""
    pattern = r"^(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)-(-?[0-9.]+(?:[eE][+-]?[0-9]+)?)$"
    return (
        F.regexp_extract(text, pattern, 1).try_cast("double"),
        F.regexp_extract(text, pattern, 2).try_cast("double"),
    )


def split_key(text: Column, sep: str = "|") -> tuple[Column, Column]:
    """``"app|version.csv"`` to its two parts, extension removed."""
    stem = F.regexp_replace(text, r"\.[A-Za-z]+$", "")
    return F.substring_index(stem, sep, 1), F.substring_index(stem, sep, -1)


def record_tags(json_text: Column) -> Column:
    """A JSON bag as ``map<string,string>``."""
    return F.from_json(json_text, "map<string,string>")
