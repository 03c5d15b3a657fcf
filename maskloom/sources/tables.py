"""Readers and writers: labelled rows with their constraints, external span tables, receipts, masks as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.schema import LABELLED, REGION_LABELS, SPAN

# Languages, and the limits of a labelled row in characters, spans and characters of its id.
LANGUAGES = ("de", "en", "es", "fr", "it")
MAX_CHARS, MAX_GOLD, MAX_ID = 12_000, 128, 200


def gold_valid(text: Column, gold: Column, labels: tuple[str, ...] = REGION_LABELS) -> Column:
    """Spans within the text, ordered, disjoint, of known labels."""
    inside = F.forall(gold, lambda g: (g["start"] >= 0) & (g["start"] < g["end"]) & (g["end"] <= F.length(text)) & g["label"].isin(*labels))
    ordered = F.aggregate(gold, F.struct(F.lit(0).alias("end"), F.lit(True).alias("ok")), lambda a, g: F.struct(g["end"].alias("end"), (a["ok"] & (g["start"] >= a["end"])).alias("ok")), lambda a: a["ok"])
    return F.coalesce(inside & ordered, F.lit(False))


def row_fault(split: str) -> Column:
    """Null for a good labelled row, else a fixed code that holds no text."""
    text, gold = F.col("text"), F.col("gold")
    return (
        F.when(F.col("case_id").isNull() | ~F.length("case_id").between(1, MAX_ID), "case_id_invalid")
        .when(~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False)), "language_invalid")
        .when(F.col("split").isNull() | (F.col("split") != split), "split_invalid")
        .when(text.isNull() | ~F.length(text).between(1, MAX_CHARS), "text_invalid")
        .when(gold.isNull() | (F.size(gold) > MAX_GOLD) | ~gold_valid(text, gold), "gold_invalid")
    )


def read_labelled(spark: SparkSession, path: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Good rows of a JSONL file, and (case_id, fault) of the others; malformed JSON fails the read.

    Faults also name ids that occur twice, and texts that occur with two different annotations.
    """
    rows = spark.read.schema(LABELLED).option("mode", "FAILFAST").json(path)
    faults = rows.select("case_id", row_fault(split).alias("fault")).where("fault is not null")
    twice = rows.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("case_id_repeated").alias("fault"))
    signature = F.struct("language", F.to_json(F.struct("gold")))
    conflict = rows.groupBy(F.sha2("text", 256).alias("h")).agg(F.count_distinct(signature).alias("n")).where("n > 1").select("h")
    clash = rows.join(conflict, F.sha2(rows["text"], 256) == F.col("h"), "left_semi").select("case_id", F.lit("text_conflict").alias("fault"))
    bad = faults.unionByName(twice).unionByName(clash)
    return rows.join(bad.select("case_id").distinct(), "case_id", "left_anti"), bad


def read_external(spark: SparkSession, path: str, mapping: dict[str, str], outside: tuple[str, ...] = ()) -> DataFrame:
    """language, text, text_sha256, gold, all_annotations, out_of_scope from rows with a JSON column of spans.

    Only the three columns that are needed are scanned.  Labels are mapped by a literal map; those in ``outside`` are kept apart.
    """
    rows = spark.read.parquet(path).select("language", F.col("generated_text").alias("text"), F.from_json("pii_spans", f"array<{SPAN}>").alias("all_annotations"))
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    named = F.transform("all_annotations", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.try_element_at(table, s["label"]).alias("label")))
    gold = F.filter(named, lambda s: s["label"].isNotNull())
    other = F.filter("all_annotations", lambda s: s["label"].isin(*outside))
    return rows.select("language", "text", F.sha2("text", 256).alias("text_sha256"), gold.alias("gold"), "all_annotations", other.alias("out_of_scope"))


def read_routed(spark: SparkSession, path: str, languages: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSONL file in the languages named, with the hash of their text, and those whose spans don't say what the text does.

    Malformed JSON fails the read; rows of other languages are left out; a null text or list of spans counts as a fault.
    """
    rows = spark.read.schema("language string, source_text string, privacy_mask array<struct<start:int,end:int,label:string,value:string>>").option("mode", "FAILFAST").json(path)
    rows = rows.where(F.col("language").isin(*languages)).withColumn("text_sha256", F.sha2("source_text", 256))
    text = F.col("source_text")
    same = F.forall("privacy_mask", lambda m: (m["start"] >= 0) & (m["end"] >= m["start"]) & (m["end"] <= F.length(text)) & (F.substring(text, m["start"] + 1, m["end"] - m["start"]) == m["value"]))
    good = F.coalesce(same & text.isNotNull(), F.lit(False))
    return rows.where(good), rows.where(~good)


def mask_json(entities: Column, masked: Column) -> Column:
    """The command line's JSON: masked_text and entities, nothing of the input beside."""
    return F.to_json(F.struct(masked.alias("masked_text"), entities.alias("entities")))


def write_canonical(rows: DataFrame, path: str) -> None:
    """One JSON object a line with its keys in order; refuses to replace what is there."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.mode("errorifexists").text(path)


def verified_receipts(rows: DataFrame, path: str) -> DataFrame:
    """Write receipts, read them again, and give rows that differ on either side: none if all is well."""
    rows.write.mode("errorifexists").parquet(path)
    back = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return rows.exceptAll(back).unionByName(back.exceptAll(rows))
