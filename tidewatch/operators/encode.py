"""Category encoders fitted on train and applied to any table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.series import BROADCAST_ROWS

# Smoothing of the target mean and of the weight of evidence.
TARGET_PRIOR_ROWS = 20.0
EVIDENCE_REGULARISATION = 1.0
RARE_SHARE = 0.001
OTHER = "other"


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of a per-category table; broadcast only when its size is counted and small."""
    side = F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table
    return df.join(side, key, "left")


def target_means(train: DataFrame, column: str, target: str, prior_rows: float = TARGET_PRIOR_ROWS) -> DataFrame:
    """Smoothed target mean per category: (sum + prior * m) / (n + m); no rows or labels, prior 0."""
    prior = train.agg(F.avg(F.col(target).cast("double"))).first()[0] or 0.0
    return train.groupBy(column).agg(
        ((F.coalesce(F.sum(F.col(target).cast("double")), F.lit(0.0)) + F.lit(prior * prior_rows)) / (F.count(F.lit(1)) + F.lit(prior_rows))).alias("_code")
    )


def target_encode(train: DataFrame, df: DataFrame, column: str, target: str, **kw) -> DataFrame:
    """Category replaced by its smoothed target mean; unseen or NULL gives 0."""
    rows = lookup(df, target_means(train, column, target, **kw), column)
    return rows.withColumn(column, F.coalesce("_code", F.lit(0.0))).drop("_code")


def evidence(train: DataFrame, column: str, target: str, r: float = EVIDENCE_REGULARISATION) -> DataFrame:
    """Weight of evidence per category: ln share of positives - ln share of negatives."""
    t = train.agg(F.count_if(F.col(target) == 1).alias("p"), F.count_if(F.col(target) == 0).alias("n")).first()
    pos, neg = F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)
    return train.groupBy(column).agg(
        (F.ln((pos + r) / F.lit(t["p"] + 2 * r)) - F.ln((neg + r) / F.lit(t["n"] + 2 * r))).alias("_code")
    )


def evidence_encode(train: DataFrame, df: DataFrame, column: str, target: str, **kw) -> DataFrame:
    rows = lookup(df, evidence(train, column, target, **kw), column)
    return rows.withColumn(column, F.coalesce("_code", F.lit(0.0))).drop("_code")


def hash_encode(df: DataFrame, columns: Sequence[str], buckets: int = 8, prefix: str = "col_") -> DataFrame:
    """Feature hashing: each category adds 1 to one of ``buckets`` columns."""
    slots = [F.pmod(F.xxhash64(F.lit(c), F.col(c).cast("string")), F.lit(buckets)) for c in columns]

    def hits(b: int) -> Column:
        total = F.lit(0)
        for s in slots:
            total = total + F.when(s == b, 1).otherwise(0)
        return total

    return df.withColumns({f"{prefix}{b}": hits(b) for b in range(buckets)}).drop(*columns)


def ordinals(train: DataFrame, column: str) -> DataFrame:
    """1-based code per distinct train value in value order (one row per category)."""
    from tidewatch.series import POS, SeriesSpec, with_positions

    values = train.select(column).where(F.col(column).isNotNull()).distinct()
    return with_positions(values, SeriesSpec((), (column,), "")).select(column, (F.col(POS) + 1).alias("_code"))


def base_n_encode(train: DataFrame, df: DataFrame, column: str, base: int = 2) -> DataFrame:
    """Ordinal code written in base ``base``, one digit column each; unseen categories are all 0."""
    codes = ordinals(train, column)
    n = codes.count()
    digits = 1
    while base**digits <= n:
        digits += 1
    rows = lookup(df, codes, column).withColumn("_code", F.coalesce("_code", F.lit(0)))
    return rows.withColumns(
        {f"{column}_{i}": (F.floor(F.col("_code") / F.lit(base ** (digits - 1 - i))) % base).cast("int") for i in range(digits)}
    ).drop("_code", column)


def categories(train: DataFrame, column: str, limit: int = 10_000) -> list:
    found = [r[0] for r in train.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} categories; take one_hot_cells or one_hot_vector")
    return sorted(found)


def one_hot(train: DataFrame, df: DataFrame, column: str, check: bool = True) -> DataFrame:
    """Columns ``column_value`` for all train values but the first; the column is dropped.

    A value unseen in train would give NULLs: with ``check`` that raises.
    """
    values = categories(train, column)
    if check:
        unseen = df.where(F.col(column).isNull() | ~F.col(column).isin(values)).limit(1).count()
        if unseen:
            raise ValueError(f"{column} holds values that train does not have")
    known = F.col(column).isin(values)
    new = {f"{column}_{v}": F.when(known, (F.col(column) == F.lit(v)).cast("int")) for v in values[1:]}
    return df.withColumns(new).drop(column)


def _positions(train: DataFrame, df: DataFrame, column: str, check: bool) -> tuple[DataFrame, int]:
    """``df`` with ``_position`` (0-based column of its category, -1 for the first one, NULL for one
    that train does not have), and the number of columns.  Categories stay a distributed table."""
    codes = ordinals(train, column).select(column, (F.col("_code") - 2).cast("int").alias("_position"))
    rows = lookup(df, codes, column)
    if check and not rows.where(F.col("_position").isNull()).isEmpty():
        raise ValueError(f"{column} holds values that train does not have")
    return rows, max(codes.count() - 1, 0)


def one_hot_cells(train: DataFrame, df: DataFrame, column: str, check: bool = True) -> DataFrame:
    """The cells that ``one_hot`` sets to 1, for any number of categories: the rows of ``df`` without the
    column, with ``position`` (0-based; NULL for the first category, all of whose cells are 0) and
    ``size`` (number of columns).

    With ``check`` a value unseen in train raises; without, its row has neither position nor size.
    """
    rows, size = _positions(train, df, column, check)
    position = F.when(F.col("_position") >= 0, F.col("_position")).alias("position")
    known = F.when(F.col("_position").isNotNull(), F.lit(size)).alias("size")
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != column], position, known)


def one_hot_vector(train: DataFrame, df: DataFrame, column: str, out: str = "vector") -> DataFrame:
    """The same as a sparse vector of ``size`` places, for the estimators; unseen values raise."""
    from pyspark.ml.feature import OneHotEncoder

    rows, size = _positions(train, df, column, True)
    # the encoder leaves out the last index: that is where the first category goes
    index = F.when(F.col("_position") < 0, F.lit(size)).otherwise(F.col("_position")).cast("double")
    indexed = rows.withColumn("_index", index).drop("_position", column)
    sizes = df.sparkSession.range(size, size + 1).select(F.col("id").cast("double").alias("_index"))
    model = OneHotEncoder(inputCol="_index", outputCol=out, dropLast=True).fit(sizes)
    return model.transform(indexed).drop("_index")


def replace_rare(train: DataFrame, df: DataFrame, column: str, counted: str, cutoff: float = RARE_SHARE) -> DataFrame:
    """Categories below cutoff * total become "other"; values unseen in train become NULL."""
    counts = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(counted).alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    mapping = counts.select(column, F.when(F.col("_n") < F.lit(total * cutoff), F.lit(OTHER)).otherwise(F.col(column)).alias("_to"))
    return lookup(df, mapping, column).withColumn(column, F.col("_to")).drop("_to")


def category_difference(train: DataFrame, df: DataFrame, column: str, number: str) -> DataFrame:
    """``{column}_cat_diff``: number minus the train mean of its category (unseen gives NULL)."""
    means = train.groupBy(column).agg(F.avg(number).alias("_mean"))
    return lookup(df, means, column).withColumn(f"{column}_cat_diff", F.col(number) - F.col("_mean")).drop("_mean")


def derive(df: DataFrame, name: str, a: str, b: str, fn: Callable[[Column, Column], Column]) -> DataFrame:
    return df.withColumn(name, fn(F.col(a), F.col(b)))


def interaction(df: DataFrame, a: str, b: str) -> DataFrame:
    """Category cross ``a_b``."""
    return df.withColumn(f"{a}_{b}", F.concat(F.col(a).cast("string"), F.col(b).cast("string")))
