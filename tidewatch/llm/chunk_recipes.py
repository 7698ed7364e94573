"""Exact duplicates by content-defined chunk recipes.

1. Every normalised text is cut where its content says so: a chunk ends at the first white space
   after ``MIN_CHUNK`` characters whose neighbours are of ``NEAR``, after ``MAX_CHUNK`` at the latest,
   so that texts that share a passage soon share its chunks.  The chunks of a text put together
   are the text.
2. Chunks are deduplicated to verified identifiers: equal contents are collapsed, map-side first, so
   a passage of a third of all documents moves once per task.  The identifier is the content's hash
   and its rank among the different contents that have this hash (0 unless hashes clash), so equal
   identifiers mean equal bytes.
3. A document's recipe is the ordered list of its identifiers, a few bytes per hundred of text.
   Equal recipes are equal texts; only recipes are grouped and joined, documents are not moved again.

All steps are DataFrame expressions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, text_of

#: Characters of a chunk, from its start: none ends before MIN_CHUNK, all end by MAX_CHUNK.
MIN_CHUNK, MAX_CHUNK = 96, 2048
#: Letters around the white space at a cut (two before, one behind): about one word end in twenty.
NEAR = "[a-hα-ηа-иا-ذ]"
#: Rows of one recipe that go to one task; the parts of larger groups are dealt.
DEAL = 20_000
SALTS = 32
#: The least long stands for a missing id where ids are ranked.
NO_ID = -(2**63)


def normalised(text_col: str) -> Column:
    """The text with A-Z in lower case and nothing else changed; a missing one is empty."""
    return F.translate(text_of(text_col), string.ascii_uppercase, string.ascii_lowercase)


def chunks_of(text: Column, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order; none for an empty one."""
    cut = rf"(?s).{{{shortest - 1},{longest - 1}}}?(?<={NEAR}{NEAR})\s(?={NEAR})|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def hash_of(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits >= 64 else F.xxhash64(chunk).bitwiseAND(F.lit((1 << bits) - 1))


def clashing(docs: DataFrame, text_col: str, shortest: int, longest: int, bits: int) -> DataFrame | None:
    """(h, chunk, rank): the contents that share their hash with another, the most frequent of a hash
    ranked 0; none if every hash has one content.  Verification: contents are grouped by their bytes,
    and every hash that more than one of them has is found."""
    chunk = docs.select(F.explode(chunks_of(normalised(text_col), shortest, longest)).alias("chunk"))
    contents = chunk.select(hash_of(F.col("chunk"), bits).alias("h"), "chunk").groupBy("h", "chunk").agg(F.count(F.lit(1)).alias("n"))
    contents = stored(contents, "chunks")  # one row per content
    several = stored(contents.groupBy("h").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("h"), "clashes")
    if several.isEmpty():  # contents move again only where hashes clash
        return None
    clash = contents.join(several, "h", "left_semi")
    place = Window.partitionBy("h").orderBy(F.desc("n"), "chunk")
    ranked = clash.select("h", "chunk", (F.row_number().over(place) - 1).alias("rank"))
    return stored(ranked, "clashes")


def recipes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK, bits: int = 64, carry: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: uid (unique long), id (long), recipe (hashes of the chunks in
    order), ranks (position and rank of the chunks whose rank is not 0; null if there are none),
    n_bytes (UTF-8) and text_sha256 of the normalised text, with ``carry`` also the row itself as
    a struct.  The result is a written table.

    A missing text is an empty one and has an empty recipe; missing and repeated ids are kept.
    """
    clash = clashing(docs, text_col, shortest, longest, bits)
    no_clash = clash is None
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("_text"), *whole)
    text = F.col("_text")
    rows = rows.select(
        "uid", "id", F.transform(chunks_of(text, shortest, longest), lambda c: hash_of(c, bits)).alias("recipe"),
        F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"),
        *(["row"] if carry else []), *([] if no_clash else ["_text"]),
    )
    if no_clash:  # every hash has one content
        return stored(rows.withColumn("ranks", F.lit(None).cast("array<struct<pos:int,rank:int>>")), "recipes")
    rows = stored(rows, "texts")
    occurrence = rows.select("uid", F.posexplode(chunks_of(F.col("_text"), shortest, longest)).alias("pos", "chunk"))
    occurrence = occurrence.withColumn("h", hash_of(F.col("chunk"), bits)).withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int"))
    later = clash.where("rank > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = occurrence.join(later, ["h", "chunk", "salt"]).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    return stored(rows.drop("_text").join(found, "uid", "left"), "recipes")


def equal_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK, bits: int = 64, deal: int = DEAL,
) -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, text_sha256, n_chunks, n_bytes.

    Texts are equal if they are identical after lower-casing A-Z.  Of equal texts the row with the
    largest id stays; of rows that repeat this id, one.  Rows without an id rank below all others; if
    none of the group has an id, one stays and keep_id is null.  Missing texts equal empty ones.
    Other columns are ignored.
    """
    return decided(recipes(docs, id_col, text_col, shortest, longest, bits), deal).select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256", F.size("recipe").alias("n_chunks"), "n_bytes"
    )


def decided(made: DataFrame, deal: int = DEAL) -> DataFrame:
    """The rows of ``recipes`` with keep_id, group_size and kept."""
    key = ["recipe", "ranks"]
    groups = made.groupBy(*key).agg(
        F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id"), F.max_by("uid", F.coalesce("id", F.lit(NO_ID))).alias("_keep")
    )
    # one row per different text, with a digest that only says where rows meet
    groups = stored(groups.withColumn("_d", F.xxhash64(*key)), "recipe_groups")
    # groups above ``deal`` rows: at most rows / deal digests, so the share is raised until 10,000 do
    n = made.count()
    deal = max(deal, -(-n // 10_000))
    large = groups.where(F.col("group_size") > deal).select(F.col("_d").alias("_ld"), F.ceil(F.col("group_size") / deal).cast("int").alias("_parts")).groupBy("_ld").agg(F.max("_parts").alias("_parts"))
    large = F.broadcast(large)
    dealt = groups.join(large, F.col("_d") == F.col("_ld"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_ld", "_parts")
    right = dealt.select(F.col("_d").alias("_gd"), F.col("_part").alias("_gp"), F.col("recipe").alias("_gr"), F.col("ranks").alias("_gk"), "group_size", "keep_id", "_keep")
    rows = made.withColumn("_d", F.xxhash64(*key)).join(large, F.col("_d") == F.col("_ld"), "left")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("uid"), F.coalesce("_parts", F.lit(1))).cast("int"))
    same = (F.col("_d") == F.col("_gd")) & (F.col("_part") == F.col("_gp")) & (F.col("recipe") == F.col("_gr")) & F.col("ranks").eqNullSafe(F.col("_gk"))
    return rows.join(right, same).withColumn("kept", F.col("uid") == F.col("_keep")).drop("_d", "_ld", "_parts", "_part", "_gd", "_gp", "_gr", "_gk", "_keep")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``equal_texts`` drops, columns as they are.

    Rows are told apart by a number of their own, so those that repeat an id or have none are judged
    one by one.  Texts are written once and move once.
    """
    made = recipes(docs, id_col, text_col, carry=True)
    gone = decided(made.drop("row")).where(~F.col("kept")).select("uid")
    return made.select("uid", "row").join(gone, "uid", "left_anti").select("row.*")


UPPER_TO_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

COPIES_SQL = f"""
WITH t AS (SELECT doc_id, {UPPER_TO_LOWER} AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""
