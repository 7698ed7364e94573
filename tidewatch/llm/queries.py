"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chunk_recipes, hidden_markov, line_spread, metric_trees, minhash, mixing, pieces, projections, repeats, rules, subset_sums, token_counts, warc


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def token_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def mixing_query(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return mixed.select("doc_id", "source", "copy", size.alias("n_text_chars"), F.round("rate", 9).alias("rate"))


def repeats_query(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf, "documents")).drop("removed")


def rules_query(spark: SparkSession, sf: str) -> DataFrame:
    judged = rules.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def warc_query(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf, "pages"))


def lines_query(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = line_spread.remove_spread_lines(table(spark, sf, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def minhash_query(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), k=2)


def pieces_query(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def vectors_query(spark: SparkSession, sf: str) -> DataFrame:
    return projections.near_vectors(table(spark, sf, "embeddings"))


def markov_query(spark: SparkSession, sf: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf, "documents"))


def codes_query(spark: SparkSession, sf: str) -> DataFrame:
    return metric_trees.compress(table(spark, sf, "embeddings"))[0]


def recipes_query(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_recipes.equal_texts(table(spark, sf, "documents")).drop("n_chunks", "n_bytes")


def negatives_query(spark: SparkSession, sf: str) -> DataFrame:
    return subset_sums.hard_negatives(subset_sums.relabelled(table(spark, sf, "embeddings")))


def pipeline_query(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts_query,
    "op2_poisson_mixing": mixing_query,
    "op3_repeated_strings": repeats_query,
    "op4_quality_rules": rules_query,
    "op5_warc_revisits": warc_query,
    "op6_line_spread": lines_query,
    "op7_minhash": minhash_query,
    "op8_sentencepiece": pieces_query,
    "op9_sorted_projections": vectors_query,
    "op10_hidden_markov": markov_query,
    "op11_metric_trees": codes_query,
    "op12_chunk_recipes": recipes_query,
    "op13_subset_sums": negatives_query,
    "pipeline": pipeline_query,
}

#: The others are tested against brute force, the tokenizers' libraries or held-out texts.
SQL: dict[str, str] = {
    "op2_poisson_mixing": mixing.MIX_SQL,
    "op5_warc_revisits": warc.WARC_SQL,
    "op6_line_spread": line_spread.LINES_SQL,
    "op11_metric_trees": metric_trees.CODES_SQL,
    "op12_chunk_recipes": chunk_recipes.COPIES_SQL,
    "op13_subset_sums": subset_sums.NEGATIVES_SQL,
}
