"""Mixing sources to target weights by Poisson replication.

The target weight of a source and its present size give a mean repetition rate.  Every document draws
its number of copies from the Poisson distribution with that mean by inverting it at a uniform value
taken from a seeded hash of the document, so a draw depends on nothing but the document, its rate and
the seed.  A mean above ``PART_MEAN`` is the sum of equal parts, each drawn with a hash of its own
(sums of Poisson values are Poisson), so that no probability underflows.  The copies are shuffled
globally: dealt and ordered by another hash.  All steps are DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import BROADCAST_ROWS

PART_MEAN = 16.0
#: Terms of the inverted sum: the tail of a part beyond them is below 2e-25.
TERMS = 80
SALTS = 32


def uniform(*parts: Column) -> Column:
    """A value in (0, 1) from the first 13 hexadecimal digits (52 bits) of an md5 of the parts."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def poisson(mean: Column, u: Column) -> Column:
    """The smallest k whose cumulated probability reaches ``u`` (mean at most ``PART_MEAN``)."""
    zero = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("s"), F.lit(0).alias("k"))

    def step(a: Column, i: Column) -> Column:
        p = a["p"] * mean / i
        return F.when(a["s"] >= u, a).otherwise(F.struct(p.alias("p"), (a["s"] + p).alias("s"), i.alias("k")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda a: a["k"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None, source_col: str, size: Column) -> DataFrame:
    """(source, weight, rate): rate = weight * total / size of the source.

    Without ``weights`` every source gets the same.  Weights need not sum to 1; a source that has
    none gets 0 copies, one without size keeps its rows (rate 1).
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).cast("long").alias("size"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        named = [F.when(F.col("source") == F.lit(s), F.lit(float(w))) for s, w in weights.items()]
        sizes = sizes.withColumn("weight", F.coalesce(*named, F.lit(0.0)))
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    rate = F.col("weight") * F.col("all_size") / (F.col("all_weight") * F.col("size"))
    return sizes.join(F.broadcast(total)).select("source", "weight", F.when(F.col("size") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(F.lit(1.0)).alias("rate"))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``docs`` with every row 0, 1 or more times, in random order, and the columns ``copy`` (1, 2, ...)
    and ``rate``; a source's characters then make up its target weight in the mean.

    Rows without a source form a source of their own; missing texts have size 0; a row without an
    id draws by the digest of its text; rows that repeat an id draw the same count.  Columns of ``docs`` named like the
    new ones are replaced.
    """
    rates = source_rates(docs, weights, source_col, F.coalesce(F.length(text_col), F.lit(0)))
    kept = [c for c in docs.columns if c not in ("copy", "rate")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    right = rates.select(F.col("source").alias("_source"), F.col("rate").alias("rate"))
    if right.count() <= BROADCAST_ROWS:  # sources, not rows
        joined = rows.join(F.broadcast(right), F.col(source_col).eqNullSafe(F.col("_source")))
    else:  # a hot source is dealt to SALTS tasks
        dealt = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("_s", F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("_s") == F.col("_salt"))).drop("_s", "_salt")
    who = F.coalesce(F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    n_parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    drawn = F.aggregate(
        F.sequence(F.lit(1), n_parts), F.lit(0),
        lambda total, i: total + poisson(F.col("rate") / n_parts, uniform(F.lit(str(seed)), who, i.cast("string"))),
    )
    copies = joined.withColumn("_n", drawn).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    key = F.md5(F.concat_ws("|", F.lit(f"order {seed}"), who, F.col("copy").cast("string"), F.xxhash64(source_col, text_col).cast("string")).cast("binary"))
    return copies.withColumn("_key", key).repartition("_key").sortWithinPartitions("_key").select(*kept, "copy", "rate")


MIX_SQL = """
WITH RECURSIVE sizes AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM documents GROUP BY source),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE * (SELECT sum(size) FROM sizes)::DOUBLE / ((SELECT count(*) FROM sizes)::DOUBLE * size::DOUBLE) ELSE 1.0::DOUBLE END AS rate
  FROM sizes),
parts AS (SELECT source, rate, greatest(ceil(rate / 16.0::DOUBLE), 1)::INTEGER AS n_parts, rate / greatest(ceil(rate / 16.0::DOUBLE), 1) AS mean FROM rates),
terms(source, mean, k, p, s) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM parts
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), s + p * mean / (k + 1) FROM terms WHERE k < 80),
draws AS (
  SELECT d.doc_id, d.source, r.rate, i.part, r.mean,
         (CAST('0x' || substr(md5('1|' || coalesce(CAST(d.doc_id AS VARCHAR), md5(coalesce(d.text, ''))) || '|' || CAST(i.part AS VARCHAR)), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts r ON d.source IS NOT DISTINCT FROM r.source, LATERAL (SELECT unnest(range(1, r.n_parts + 1)) AS part) i),
counts AS (
  SELECT w.doc_id, w.part, count(*) FILTER (WHERE t.s < w.u) AS n
  FROM draws w JOIN terms t ON w.source IS NOT DISTINCT FROM t.source WHERE t.k < 80 GROUP BY w.doc_id, w.part),
totals AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY doc_id)
SELECT d.doc_id, d.source, CAST(c.copy AS INTEGER) AS copy, CAST(coalesce(length(d.text), 0) AS BIGINT) AS n_text_chars, round(r.rate, 9) AS rate
FROM documents d JOIN totals t ON d.doc_id = t.doc_id JOIN rates r ON d.source IS NOT DISTINCT FROM r.source, LATERAL (SELECT unnest(range(1, t.n + 1)) AS copy) c
WHERE t.n > 0
"""
