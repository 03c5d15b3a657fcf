"""Dataset work: hash-ordered samples, leakage checks, conflicts, summaries, run ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def hash_topk(rows: DataFrame, k: int, group: str, tie: str, text: str = "text") -> DataFrame:
    """The k rows of each group that come first by (sha256 of text, tie): a sample that doesn't depend on row order.

    The rank limit is pushed below the exchange as a group limit, so a hot group sends k rows per task.
    """
    w = Window.partitionBy(group).orderBy("text_sha256", tie)
    return rows.withColumn("text_sha256", text_hash(F.col(text))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hash_sample(rows: DataFrame, k: int, tie: str, text: str = "text") -> DataFrame:
    """The first k rows of all by (sha256 of text, tie)."""
    return rows.withColumn("text_sha256", text_hash(F.col(text))).orderBy("text_sha256", tie).limit(k)


def without_texts_of(rows: DataFrame, reserved: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text's hash doesn't occur in ``reserved``."""
    keys = reserved.select(text_hash(F.col(text)).alias("_h")).distinct()
    return rows.join(keys, text_hash(rows[text]) == F.col("_h"), "left_anti")


def shared_texts(left: DataFrame, right: DataFrame, text: str = "text") -> DataFrame:
    """Hashes of texts on both sides, each once; empty if the sets are disjoint."""
    return left.select(text_hash(F.col(text)).alias("text_sha256")).intersect(right.select(text_hash(F.col(text)).alias("text_sha256")))


def conflicting_texts(rows: DataFrame, signature: Column, text: str = "text") -> DataFrame:
    """Texts that occur with more than one signature: text_sha256, copies, signatures."""
    g = rows.groupBy(text_hash(F.col(text)).alias("text_sha256")).agg(F.count("*").alias("copies"), F.count_distinct(signature).alias("signatures"))
    return g.where("signatures > 1")


def summary_cube(rows: DataFrame, *dims: str) -> DataFrame:
    """Rows, clean rows and spans (columns n_spans) for every combination of the dimensions and their totals."""
    named = [F.coalesce(F.col(d).cast("string"), F.lit("?")).alias(d) for d in dims]
    cube = rows.select(*named, "n_spans").cube(*dims).agg(F.count("*").alias("row_count"), F.count_if(F.col("n_spans") == 0).alias("clean_rows"), F.sum("n_spans").cast("bigint").alias("span_count"))
    return cube.select(*(F.coalesce(d, F.lit("*")).alias(d) for d in dims), "row_count", "clean_rows", "span_count")


def ordered_digest(rows: DataFrame, key: str) -> DataFrame:
    """sha256 over the sorted distinct values of a column of short strings, in two levels.

    Values are digested by leading character first, so no task holds all of them; then the digests in order.
    """
    parts = rows.select(F.col(key).alias("v")).distinct().groupBy(F.substring("v", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("v")), "\n"), 256).alias("d"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"), F.sum("n").alias("values"))


def not_yet_run(wanted: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Runs that the ledger doesn't hold."""
    return wanted.join(ledger.select(*keys).distinct(), keys, "left_anti")
