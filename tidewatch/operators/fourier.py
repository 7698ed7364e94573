"""Discrete Fourier transforms of whole series of any length, distributed.

A series of M = n1 * n2 values is a grid: the columns (values whose position is equal modulo n2) are
transformed, multiplied by twiddle factors, and the rows of the result are transformed.  A task
holds one column or row of about sqrt(M) values, so no series has to fit into one.  Lengths that are
no power of two go through the chirp form: a convolution of a power-of-two length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Indexes of the chirp filter that one row is unfolded to.
INDEX_BLOCK = 100_000
#: Results of a transform that a task makes at once.
CELLS = 200_000
J, M, RE, IM = "_j", "_m", "_re", "_im"


def power_of_two(least: Column) -> Column:
    """The smallest power of two that is at least ``least`` (and at least 1)."""
    bits = F.ceil(F.log2(F.greatest(least, F.lit(1)).cast("double"))).cast("int")
    size = F.pow(F.lit(2.0), bits).cast("long")
    return F.when(size >= least, size).otherwise(2 * size)


def _side(m: Column) -> Column:
    """n1, the power of two nearest below or at the square root of M."""
    return F.pow(F.lit(2.0), F.floor(F.log2(m.cast("double")) / 2)).cast("long")


def _starts(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    """The rows at which a new line begins (equal values of ``names`` stand together)."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for name in names:
        codes = table.column(name).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def _lines(df: DataFrame, keys: Sequence[str], line: str, inverse: bool, twiddle: bool) -> DataFrame:
    """Transform each (key, line): the values at ``_at``; ``_len`` values in all, missing ones are 0.

    Cells stay rows: sorted by line they come in batches, and a task holds a batch and ``CELLS`` results."""
    names = [*keys, M, line]
    sign = 1.0 if inverse else -1.0

    def lines(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        at, re, im, size, line_no, total = (table.column(c).to_numpy() for c in ("_at", RE, IM, "_len", line, M))
        first = 0
        while first < len(starts):
            n = int(size[starts[first]])
            most = min(len(starts), first + max(1, CELLS // n))
            other = np.flatnonzero(size[starts[first:most]] != n)  # series of another length follow
            last = first + int(other[0]) if len(other) else most
            mine = slice(starts[first], starts[last] if last < len(starts) else table.num_rows)
            x = np.zeros((last - first, n), dtype=complex)
            x[number[mine] - first, at[mine]] = re[mine] + 1j * im[mine]
            y = np.fft.ifft(x, axis=1) * n if inverse else np.fft.fft(x, axis=1)
            if twiddle:
                i, m = line_no[starts[first:last], None].astype(np.int64), total[starts[first:last], None]
                y = y * np.exp(sign * 2j * np.pi * ((np.arange(n, dtype=np.int64) * i) % m) / m)
            head = table.take(pa.array(np.repeat(starts[first:last], n))).select(names)
            columns = [*[c.combine_chunks() for c in head.columns], pa.array(np.tile(np.arange(n, dtype=np.int64), last - first)), pa.array(y.real.reshape(-1)), pa.array(y.imag.reshape(-1))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_k", RE, IM])
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                table = table if kept is None else pa.concat_tables([kept, table])
                starts = _starts(table, names)
                if len(starts) > 1:  # the last line may go on in the next batch
                    yield from lines(table.slice(0, starts[-1]), starts[:-1])
                kept = table.slice(starts[-1])
        if kept is not None:
            yield from lines(kept, np.zeros(1, np.int64))

    cells = df.select(*names, "_len", "_at", RE, IM)
    schema = cells.select(*names, F.lit(0).cast("long").alias("_k"), F.lit(0.0).alias(RE), F.lit(0.0).alias(IM)).schema
    return cells.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, schema)


def transform(df: DataFrame, keys: Sequence[str], inverse: bool = False) -> DataFrame:
    """Rows (keys, _m, _j, _re, _im) to the transform over _j, again in _j; _m (a power of two) is the
    length of the series, values without a row are 0.  The inverse is not divided by _m."""
    n1 = _side(F.col(M))
    n2 = (F.col(M) / n1).cast("long")
    grid = df.withColumn("_line", F.col(J) % n2).withColumn("_at", F.floor(F.col(J) / n2).cast("int")).withColumn("_len", n1.cast("int"))
    columns = _lines(grid, keys, "_line", inverse, twiddle=True)
    rows = columns.select(*keys, M, F.col("_k").alias("_row"), F.col("_line").cast("int").alias("_at"), n2.cast("int").alias("_len"), RE, IM)
    out = _lines(rows, keys, "_row", inverse, twiddle=False)
    return out.select(*keys, M, (F.col("_row") + n1 * F.col("_k")).alias(J), RE, IM)


def _turn(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    """(re + i im) * exp(i angle)."""
    c, s = F.cos(angle), F.sin(angle)
    return re * c - im * s, re * s + im * c


def _chirp(j: Column, n: Column) -> Column:
    """pi j^2 / n, the square reduced modulo 2 n first (j * j fits a long up to three billion rows)."""
    return F.pmod(j * j, 2 * n) / n * math.pi


def _offsets(sizes: DataFrame, block: int | None = None) -> DataFrame:
    """(_n, _m, _s) with _s = 1 - _n .. _n - 1: blocks of indexes are dealt over the tasks, and every block
    is written out where it lands."""
    block = block or INDEX_BLOCK
    first = 1 - F.col("_n")
    numbered = sizes.select("_n", M, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((2 * F.col("_n") - 2) / block))).alias("_b"))
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    start = first + F.col("_b") * block
    inside = F.sequence(start, F.least(start + block - 1, F.col("_n") - 1))
    return numbered.repartition(tasks, "_n", "_b").select("_n", M, F.explode(inside).alias("_s"))


def any_length(df: DataFrame, keys: Sequence[str], pos: str, total: str, value: Column) -> DataFrame:
    """The transform of each whole series: rows (keys, n, bin, re, im), bin 0..n - 1, of
    sum(value * exp(-2 pi i bin pos / n)).  ``pos`` is 0-based, ``total`` the length."""
    n, j = F.col(total).cast("long"), F.col(pos).cast("long")
    re, im = _turn(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0), -_chirp(j, n))
    rows = df.select(*keys, n.alias("_n"), power_of_two(2 * n).alias(M), j.alias(J), re.alias(RE), im.alias(IM))
    sizes = rows.select("_n", M).distinct()
    around = _offsets(sizes)
    angle = _chirp(F.col("_s"), F.col("_n"))
    filters = around.select("_n", M, F.pmod(F.col("_s"), F.col(M)).alias(J), F.cos(angle).alias(RE), F.sin(angle).alias(IM))
    mine = transform(rows, [*keys, "_n"])
    theirs = transform(filters, ["_n"]).select(F.col("_n").alias("_fn"), F.col(J).alias("_fj"), F.col(RE).alias("_fr"), F.col(IM).alias("_fi"))
    # as long as the series: never to be sent whole, however small its size is guessed
    both = mine.join(theirs.hint("merge"), (F.col("_n") == F.col("_fn")) & (F.col(J) == F.col("_fj")))
    product = both.select(
        *keys, "_n", M, J, (F.col(RE) * F.col("_fr") - F.col(IM) * F.col("_fi")).alias(RE), (F.col(RE) * F.col("_fi") + F.col(IM) * F.col("_fr")).alias(IM)
    )
    back = transform(product, [*keys, "_n"], inverse=True).where(F.col(J) < F.col("_n"))
    re, im = _turn(F.col(RE) / F.col(M), F.col(IM) / F.col(M), -_chirp(F.col(J), F.col("_n")))
    return back.select(*keys, F.col("_n").alias("n"), F.col(J).alias("bin"), re.alias("re"), im.alias("im"))


def lagged_products(df: DataFrame, keys: Sequence[str], pos: str, total: str, value: Column) -> DataFrame:
    """Rows (keys, n, lag, _sum) with _sum = sum over t of value_t * value_(t + lag), lag 0..n - 1: the
    power spectrum of the series padded to twice its length, transformed back."""
    n, j = F.col(total).cast("long"), F.col(pos).cast("long")
    rows = df.select(*keys, n.alias("_n"), power_of_two(2 * n).alias(M), j.alias(J), F.coalesce(value.cast("double"), F.lit(0.0)).alias(RE), F.lit(0.0).alias(IM))
    power = transform(rows, [*keys, "_n"]).select(*keys, "_n", M, J, (F.col(RE) * F.col(RE) + F.col(IM) * F.col(IM)).alias(RE), F.lit(0.0).alias(IM))
    back = transform(power, [*keys, "_n"], inverse=True).where(F.col(J) < F.col("_n"))
    return back.select(*keys, F.col("_n").alias("n"), F.col(J).alias("lag"), (F.col(RE) / F.col(M)).alias("_sum"))

