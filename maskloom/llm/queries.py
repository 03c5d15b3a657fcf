"""The queries of this subpackage, one per operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from maskloom.llm import common, contamination, jaccard, katz, lines, neighbours, packing, quality, records, substrings, toxicity


def op1_site_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(common.table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed")


def op2_framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "records")
    shards = records.write_records(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return records.read_records(shards, path, with_ids=False)


def op3_quality_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_texts(common.table(spark, sf_dir, "documents"), min_count=1)


def op5_trie_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_cgk_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op7_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(common.table(spark, sf_dir, "documents"), with_text=False)


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def op10_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(common.table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_spread_lines": op1_site_spread_lines,
    "op2_framed_records": op2_framed_records,
    "op3_quality_kernel": op3_quality_kernel,
    "op4_katz_backoff": op4_katz_backoff,
    "op5_trie_jaccard": op5_trie_jaccard,
    "op6_cgk_contamination": op6_cgk_contamination,
    "op7_block_anchors": op7_block_anchors,
    "op8_pattern_packing": op8_pattern_packing,
    "op9_toxicity_grammar": op9_toxicity_grammar,
    "op10_sorted_projections": op10_sorted_projections,
}

ORACLE_SQL: dict[str, str] = {"op1_site_spread_lines": lines.oracle()}
