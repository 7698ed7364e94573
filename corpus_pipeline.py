"""Preparing a training corpus: five stages over ``documents``, each written before the next reads it.

1. quality: documents that the learned rules (or the base rules) reject go.
2. lines: boilerplate lines that stand on many sites are taken out (short ones must stand on more);
   equal whole texts count once.
3. near_duplicates: of each group of near-duplicates (five-word shingles, similarity 0.8) the
   document with the smallest id stays, one row of it if the id repeats, one without an id only if none
   has one; texts without words stay.
4. mixing: every source is repeated or thinned to the same share of the characters, in random order.
5. pieces: every text is encoded and decoded with the SentencePiece model.

Every stage works on all rows its predecessor kept and, but for the last, returns the columns of
``documents``.  Null texts fail the base rules; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import line_spread, minhash, mixing, pieces, rules
from tidewatch.llm.common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_spread.remove_spread_lines(docs, min_chars=20).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are known by a number of their own, so repeated and missing ids are told apart
    numbered = stored(docs.select(*docs.columns, F.monotonically_increasing_id().alias("_row")), "numbered")
    found = minhash.near_duplicates(numbered, id_col="_row").select("_row", "component_id")
    ranked = found.join(numbered.select("_row", "doc_id"), "_row")
    first = F.min_by("_row", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row")))
    stay = ranked.groupBy("component_id").agg(first.alias("_row")).select("_row")
    return numbered.join(stay, "_row", "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: Learned rules are outside SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
