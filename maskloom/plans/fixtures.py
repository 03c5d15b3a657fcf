"""Inputs for the named queries: spans and identifiers derived from the driver's tables by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions.rx import EMAIL, labelled_spans
from maskloom.schema import SPAN

CAPITALISED, SHORT = "[A-Z][a-z]{5,}", r"[A-Z][a-z]+[.,]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """doc, start, end, label, source, ord from line items."""
    start = F.col("l_linenumber") * 5 + F.col("l_partkey") % 17
    label = F.element_at(F.array(*(F.lit(x) for x in ("ADDRESS", "EMAIL", "PERSONNAME", "GIVENNAME"))), F.col("l_linenumber") % 4 + 1)
    return table(spark, sf_dir, "lineitem").where(where).select(
        F.col("l_orderkey").alias("doc"), start.cast("int").alias("start"), (start + 1 + F.col("l_suppkey") % 9).cast("int").alias("end"), label.alias("label"),
        F.when(F.col("l_partkey") % 2 == 0, "regex").otherwise("mbert").alias("source"), F.col("l_linenumber").cast("int").alias("ord"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir, "l_suppkey % 3 = 0")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir, "l_suppkey % 3 <> 0")


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, text, gold (e-mails and long capitalised words), pred (e-mails and words before a stop)."""
    text = F.col("text")
    mail, names, short = labelled_spans(text, EMAIL, "EMAIL"), labelled_spans(text, CAPITALISED, "PERSONNAME"), labelled_spans(text, SHORT, "PERSONNAME")
    both = lambda a, b: F.concat(a, b).cast(f"array<{SPAN}>")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce(text, F.lit("")).alias("text"), both(mail, names).alias("gold"), both(mail, short).alias("pred"))


def digits(column: str, width: int) -> Column:
    return F.lpad(F.col(column).cast("string"), width, "0")
