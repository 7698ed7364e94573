"""Vectors as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import over_batches

#: Larger components count as this: sums of products over thousands of components fit 64 bits.
LARGEST = 2**25


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id long, label, size, raw): floor(scale * x) of every component as little-endian int32.

    Rows whose vector is missing or holds missing or non-finite components are left out; an empty
    vector has size 0.  Results beyond +-``LARGEST`` are set to that.
    """

    def run(batch: pa.RecordBatch) -> pa.Table:
        v = batch.column("v")
        lengths = pc.fill_null(pc.list_value_length(v), 0).to_numpy().astype(np.int64)
        values = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a missing component is NaN
        ends = np.cumsum(lengths)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        fine = (bad[ends] == bad[ends - lengths]) & pc.is_valid(v).to_numpy(zero_copy_only=False)
        with np.errstate(invalid="ignore", over="ignore"):
            whole = np.clip(np.floor(np.nan_to_num(values) * scale), -LARGEST, LARGEST).astype("<i4")
        data = whole.tobytes()
        keep = np.flatnonzero(fine)
        raw = pa.array([data[4 * (ends[i] - lengths[i]) : 4 * ends[i]] for i in keep], pa.binary())
        rows = batch.take(pa.array(keep))
        return pa.table({"id": rows.column("id"), "label": rows.column("label"), "size": pa.array(lengths[keep].astype(np.int32)), "raw": raw})

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    return over_batches(rows, run, f"id long, label {kind}, size int, raw binary")


def matrix(raw: list[bytes], size: int) -> np.ndarray:
    """Rows of equal size as int64."""
    return np.frombuffer(b"".join(raw), dtype="<i4").reshape(len(raw), size).astype(np.int64)
