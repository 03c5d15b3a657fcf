"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs.  All but the last return the columns of ``documents``.  ``docs`` may hold nulls in any column, empty texts and
repeated rows; what becomes of them stands in each stage and its operator.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.llm import common, contamination, jaccard, lines, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below 0.5; null and empty texts stay."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand on ten sites or more but for their first occurrence; n_chars follows the text."""
    cut = lines.dedup_lines(docs, min_sites=10).drop("lines_removed")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles: the least doc_id.

    Rows with one doc_id are one document: they stay if one of them is its group's least.  A null doc_id stays only where no
    other document is like it.
    """
    groups = jaccard.jaccard_components(docs, size=5, percent=80)
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = groups.groupBy(F.col("doc_id").alias("gone_id")).agg(F.bool_or(same).alias("stays")).where(~F.col("stays")).select("gone_id")
    gone = common.materialise(gone, "near-copies")
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]), "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edits allowed."""
    return contamination.drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 token ids with the sequence and offset each is packed at."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Tokenizing, fitting and edit distances aren't SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialise(docs, name)
    return docs
