import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or add to their results.
CLASHES = ["copy", "rate", "n_lines", "n_removed", "id", "h", "rep", "n", "word", "batch", "bands", "digest", "component", "component_id", "kept", "n_tokens", "_counts", "_key", "_n", "found", "line", "held_out"]


@pytest.fixture(scope="session")
def documents(spark):
    """A table from (doc_id, text) or (doc_id, text, source), with columns of clashing names."""

    def make(rows, clash=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.select("*", *[F.lit("clash").alias(c) for c in CLASHES]) if clash else df

    return make
