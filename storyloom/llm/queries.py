"""Registered queries of the corpus operators: each applies its operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from storyloom.llm import (byte_bpe, compression_quality, decontaminate, edit_counts, jaccard_join, jump_shards,
                           line_dedup, merkle_manifest, quadratic_quality, rank_language, secret_ledger,
                           token_alignment, warc)
from storyloom.session import cut_lineage

#: The rank file of the token queries; a parameter of the operators.
RANKS = "byte_bpe_multi_50k.tiktoken"
SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
N_SHARDS = 24
WARC_DATE = "2024-01-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: counts and a digest of what is left."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_kept_lines", "n_near_lines",
                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and number of links."""
    return (jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))
            .select("doc_id", "class_id", "n_links"))


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document.  The English ones were delivered and scanned
    first; then all documents come, and only pairs that the ledger does not hold
    are scanned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    ledger = cut_lineage(secret_ledger.scan_unseen(docs.where(F.col("lang") == "en")))
    new = secret_ledger.scan_unseen(docs, ledger=ledger)
    return secret_ledger.report_paths(docs, ledger.unionByName(new))


def op4_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    out = jump_shards.shard_manifest(table(spark, sf_dir, "documents"), N_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their decoding, as digests."""
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS),
                                       public_tokenizers.PATTERN)


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after edits derived from it."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = edit_counts.with_trees(docs, path, pattern).withColumns(
        {"n_tokens_before": F.col("n_tokens"), "edits": edit_counts.revision_edits()})
    return edit_counts.apply_edits(trees, path, pattern).select(
        "doc_id", "n_tokens_before", "n_edits", F.col("n_tokens").alias("n_tokens_after"), "n_reencoded_chars",
        F.length("text").cast("long").alias("n_chars_after"))


def op7_rank_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return rank_language.identify(table(spark, sf_dir, "documents"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derivatives(warc.responses_from_pages(table(spark, sf_dir, "pages"), WARC_DATE))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
                        (hit > 0).alias("contaminated"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compression_quality.with_quality(docs).drop("text")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's aligned tokens, with pair counts of the corpus."""
    return token_alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path(SIDE_A),
                                   public_tokenizers.path(SIDE_B))


def op12_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quadratic_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, its proof and a tamper test."""
    leaves = merkle_manifest.leaves_of(table(spark, sf_dir, "documents"),
                                       ["doc_id", "source", "lang", "n_chars", "text"])
    return merkle_manifest.proofs(merkle_manifest.build(leaves)).withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All registered queries of this package."""
    ops = [op1_line_dedup, op2_jaccard_join, op3_secret_ledger, op4_jump_shards, op5_byte_bpe, op6_edit_counts,
           op7_rank_language, op8_warc_derivatives, op9_decontaminate, op10_compression_quality, op11_token_alignment, op12_quadratic_quality, op13_merkle_manifest]
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}
