"""WARC archives with revisit records: written, deduplicated and read with Spark's own readers.

An archive is a folder of text parts.  Every record is one row whose text ends, like every WARC
record, with two line breaks (CR LF): that is the writer's line separator.  The reader's separator is
the version line that opens a record, so parts can be split and read from any store Spark reads.  A
payload may itself hold the version line: a piece that is shorter than its Content-Length says is
joined with the pieces behind it, found from byte positions.

Deduplication moves headers only: payload digests are shuffled, each gets the smallest page of its
equals, and records that are not that page become revisits.  Reading joins revisits to the response
they refer to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import BROADCAST_ROWS, new_path, stored

VERSION = "WARC/1.0\r\n"
CLOSE = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Date of all records, so that the same pages give the same archive.
DATE = "2020-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits, eight digits each."""
    digest = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def decide(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers (page_id, digest, n, first): ``first`` is the smallest page with the same payload.

    Only headers are shuffled; the smallest page per digest is combined map-side, so a payload of a
    third of all pages is one row per task."""
    heads = pages.select("page_id", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n"))
    firsts = heads.where(F.col("n") >= min_bytes).groupBy(F.col("digest").alias("_digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("_copies"))
    several = firsts.where("_copies > 1").drop("_copies")
    return heads.where(F.col("n") >= min_bytes).join(several, F.col("digest") == F.col("_digest")).select("page_id", "digest", "n", "first").where(~F.col("page_id").eqNullSafe(F.col("first")))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, payload as text) as a deduplicated archive.

    A page whose payload of at least ``min_bytes`` bytes also stands on a smaller page becomes a
    revisit without payload, all others are responses; pages that share the smallest id (repeated
    rows) are all responses, and so are pages without an id whose equals have none either.
    """
    revisits = stored(decide(pages, min_bytes).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "first").distinct(), "revisits")
    right = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    sized = pages.withColumn("_d", base32_sha1(F.col("payload")))
    marked = sized.join(right, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_d") == F.col("_digest")), "left")
    is_revisit = F.col("_digest").isNotNull()
    head = F.concat(
        F.lit(VERSION),
        F.lit("WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), record_id(F.col("page_id")),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", " "),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_d"),
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Refers-To: "), record_id(F.col("first")), F.lit(f"\r\nWARC-Refers-To-Date: {DATE}\r\nWARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(is_revisit, F.lit(0)).otherwise(F.octet_length("payload")).cast("string"),
        F.lit(CLOSE),
    )
    body = F.when(is_revisit, F.lit("")).otherwise(F.col("payload"))
    marked.select(F.concat(head, body).alias("value")).write.option("lineSep", CLOSE).text(path)


def header(name: str, column: str = "head") -> Column:
    """The value of a header line; missing where there is none."""
    found = F.regexp_extract(column, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: kind, page_id, url, digest, refers_to (a page), length, payload."""
    pieces = spark.read.option("lineSep", VERSION).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    cut = F.locate(CLOSE, F.col("value"))
    parsed = pieces.withColumn("head", F.when(cut > 0, F.substring_index("value", CLOSE, 1))).withColumn("at", F.octet_length("head") + 4)
    parsed = parsed.withColumn("length", header("Content-Length").cast("long")).withColumn("size", F.octet_length("value").cast("long"))
    whole = F.col("length").isNotNull() & (F.col("at") + F.col("length") + 4 == F.col("size"))
    broken = parsed.where(~F.coalesce(whole, F.lit(False)) & (F.col("size") > 0))
    good = parsed
    if not broken.isEmpty():
        good = _joined(parsed, broken.select("file").distinct())
        good = good.withColumn("head", F.substring_index("value", CLOSE, 1)).withColumn("length", header("Content-Length").cast("long"))
    good = good.where(F.col("length").isNotNull())
    # the payload by bytes: it may hold any text
    body = F.substring(F.col("value").cast("binary"), F.octet_length("head") + 5, F.col("length").cast("int"))
    page = lambda name: F.regexp_extract(header(name), "<urn:page:(.*)>", 1).try_cast("long")
    return good.select(
        header("WARC-Type").alias("kind"), page("WARC-Record-ID").alias("page_id"), header("WARC-Target-URI").alias("url"),
        F.substring(header("WARC-Payload-Digest"), 6, 32).alias("digest"), page("WARC-Refers-To").alias("refers_to"), "length", body.alias("payload"),
    )


def _joined(parsed: DataFrame, files: DataFrame) -> DataFrame:
    """Records of all files, those of ``files`` put together again where a payload was cut.

    Positions of pieces are sums of sizes in file order.  A true record starts where the one before
    ends; inside a payload a piece starts before the end that its record has reached, so a running
    maximum of ends tells records from pieces.  A piece of payload can look like a record and claim
    an end of its own: its claim lies within the reach of the true record only if it is shorter, so
    claims count only for pieces that start exactly at a reached end.
    """
    w = Window.partitionBy("file").orderBy("block", "row")
    sep = len(VERSION.encode())
    mine = parsed.join(files, "file", "left_semi")
    # the first piece of a file is empty: its separator opens the first record
    placed = mine.withColumn("start", F.sum(F.col("size") + sep).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.where(F.col("start").isNotNull()).withColumn("end", F.when(F.col("length").isNotNull(), F.col("start") + F.col("at") + F.col("length") + 4 + sep))
    spans = placed.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))

    def step(a: Column, x: Column) -> Column:
        true = (x["start"] >= a["reach"]) & x["end"].isNotNull()
        return F.when(true, F.struct(x["end"].alias("reach"), F.concat(a["starts"], F.array(x["start"])).alias("starts"))).otherwise(a)

    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.array().cast("array<bigint>").alias("starts"))
    starts = spans.select("file", F.explode(F.aggregate("s", zero, step)["starts"]).alias("start")).withColumn("opens", F.lit(1))
    grouped = placed.join(starts, ["file", "start"], "left").withColumn("record", F.max(F.when(F.col("opens") == 1, F.col("start"))).over(Window.partitionBy("file").orderBy("start")))
    text = F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda x: x["value"])
    again = grouped.where(F.col("record").isNotNull()).groupBy("file", "record").agg(F.array_join(text, VERSION).alias("value"))
    fine = parsed.join(files, "file", "left_anti").select("value")
    return fine.unionAll(again.select("value"))


def resolve(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit takes
    the size of its payload from the response it refers to (missing if the archive has none)."""
    responses = records.where("kind = 'response'").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("length").alias("_length")).distinct()
    joined = records.where("kind = 'revisit'").join(responses, F.col("refers_to").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    revisits = joined.select("page_id", F.col("_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")
    own = records.where("kind = 'response'").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
    )
    return own.unionAll(revisits)


def archive_pages(pages: DataFrame, html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as an archive in the shared folder, read it back and
    resolve its revisits: one row per row of ``pages``.  A missing html counts as empty, missing
    urls and ids are allowed, other columns are ignored."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    path = new_path(pages.sparkSession, "warc")
    write_archive(rows, path, min_bytes)
    return resolve(read_archive(pages.sparkSession, path))


_GROUPS = " || ".join(f"lpad(to_base(CAST('0x' || substr(sha1(payload), {1 + 10 * i}, 10) AS BIGINT), 32), 8, '0')" for i in range(4))
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT payload, min(page_id) AS first, octet_length(encode(payload)) AS n, translate({_GROUPS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS digest
      FROM p GROUP BY payload)
SELECT p.page_id, CAST(f.n AS BIGINT) AS payload_bytes, f.digest AS payload_digest,
       CASE WHEN p.page_id = f.first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN p.page_id <> f.first THEN f.first END AS refers_to
FROM p JOIN f USING (payload)
"""
