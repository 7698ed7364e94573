"""Cross-site boilerplate lines by their distinct-site spread.

A line that is not blank is boilerplate if it stands on at least ``min_sites`` distinct sites.  Copies
of a document are not spread: equal whole texts count once, on the first of their sites, so the lines
of an article that many sites copied are left to the removal of duplicates.  ``min_chars`` asks more of lines
that are shorter (chance sentences like "Of."), rising evenly to twice ``min_sites``; 0 asks all the same.

The spread is a HyperLogLog sketch of sites per line hash, merged by aggregation (map-side first, so a
line of a third of all documents costs one sketch per task).  Estimates inside a band around the
threshold are replaced by exact distinct counts over the rows of those lines only.  All steps are DataFrame
expressions; a line is known by the md5 of its text without outer spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored

MIN_SITES = 10
LG_K = 10
#: Half the width of the band, relative: over six standard errors (1.04 / sqrt(2 ** LG_K)).
BAND = 0.25
#: Stands for a missing site; sorts before every name.
NO_SITE = "\x01"


def key_of(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def not_blank(line: Column) -> Column:
    return line.rlike("[^\\x20\\x09-\\x0D]")


def needed(line: Column, min_sites: int, min_chars: int) -> Column:
    """Sites asked of a line: ``min_sites``, rising evenly to twice as many as it gets shorter than ``min_chars``."""
    missing = F.greatest(F.lit(min_chars) - F.length(F.trim(line)), F.lit(0))
    return F.lit(min_sites) + F.ceil(missing * min_sites / max(min_chars, 1)).cast("int")


def line_rows(docs: DataFrame, site_col: str, text_col: str, min_sites: int, min_chars: int) -> DataFrame:
    """(line, need, text, site): a row per line that is not blank; rows without a site are one site.
    ``text`` is the digest of the whole text."""
    site = F.coalesce(F.col(site_col).cast("string"), F.lit(NO_SITE)).alias("site")
    parts = docs.select(site, F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("text"), F.explode(lines_of(F.col(text_col))).alias("line"))
    return parts.where(not_blank(F.col("line"))).select(key_of(F.col("line")).alias("line"), needed(F.col("line"), min_sites, min_chars).alias("need"), "text", "site")


def collapsed(rows: DataFrame) -> DataFrame:
    """(line, need, site): a row per line and different text, with the first site of the text."""
    return rows.groupBy("line", "text").agg(F.max("need").alias("need"), F.min("site").alias("site")).drop("text")


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = 0, site_col: str = "source", text_col: str = "text") -> DataFrame:
    """(line): hashes of the boilerplate lines of ``docs``."""
    rows = line_rows(docs, site_col, text_col, min_sites, min_chars)
    sketched = collapsed(rows).groupBy("line").agg(F.max("need").alias("need"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("s"))
    judged = stored(sketched.select("line", "need", F.hll_sketch_estimate("s").alias("n")).where(F.col("n") >= F.col("need") * (1 - BAND)), "spread")
    sure = judged.where(F.col("n") > F.col("need") * (1 + BAND)).select("line")
    near = judged.where(F.col("n") <= F.col("need") * (1 + BAND)).select("line")
    exact = collapsed(rows.join(near, "line", "left_semi")).groupBy("line").agg(F.max("need").alias("need"), F.countDistinct("site").alias("n"))
    return sure.unionAll(exact.where(F.col("n") >= F.col("need")).select("line"))


def remove_spread_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = 0, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and n_lines and n_removed.

    Other lines, blank ones too, keep their order and their line breaks.  A missing text stays missing (no
    lines); a text of boilerplate only becomes empty; every row stays.  Rows that share an id, a missing
    one too, are each cleaned.  Columns of ``docs`` named like the new ones are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    bad = stored(spread_lines(docs, min_sites, min_chars, site_col, text_col), "boilerplate")
    # which lines each document loses, by id and text, so that rows without an id don't meet in one task
    digest = F.xxhash64(text_col)
    mine = rows.select(F.col(id_col).alias("_id"), digest.alias("_text"), F.explode(lines_of(F.col(text_col))).alias("_l")).where(not_blank(F.col("_l")))
    lost = mine.select("_id", "_text", key_of(F.col("_l")).alias("line")).join(bad, "line").groupBy("_id", "_text").agg(F.collect_set("line").alias("_lost"))
    joined = rows.withColumn("_own", digest).join(lost, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_text")), "left")
    all_lines = lines_of(F.col(text_col))
    left = F.when(F.col("_lost").isNull(), all_lines).otherwise(F.filter(all_lines, lambda x: ~(not_blank(x) & F.array_contains("_lost", key_of(x)))))
    out = joined.withColumn("_left", left)
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(all_lines)).cast("long")
    text = F.when(F.col(text_col).isNull() | F.col("_lost").isNull(), F.col(text_col)).otherwise(F.array_join("_left", "\n"))
    counted = out.withColumn("n_lines", n_lines).withColumn("n_removed", F.when(F.col("_lost").isNull(), F.lit(0).cast("long")).otherwise(n_lines - F.size("_left")))
    return counted.withColumn(text_col, text).select(*kept, "n_lines", "n_removed")


LINES_SQL = f"""
WITH t AS (SELECT text, min(coalesce(source, chr(1))) AS site FROM documents WHERE text IS NOT NULL GROUP BY text),
s AS (SELECT site, trim(unnest(string_split(text, chr(10))), ' ') AS k FROM t),
bad AS (SELECT k FROM s WHERE regexp_matches(k, '[^\\x20\\x09-\\x0D]') GROUP BY k HAVING count(DISTINCT site) >= {MIN_SITES}),
l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
m AS (SELECT l.doc_id, l.i, l.line, b.k IS NOT NULL AS gone FROM l LEFT JOIN bad b ON trim(l.line, ' ') = b.k)
SELECT d.doc_id, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id) g
ON d.doc_id = g.doc_id
"""
