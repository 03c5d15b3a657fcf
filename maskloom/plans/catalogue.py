"""Named queries over the library's operators; ``maskloom.plans.oracle`` holds their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskloom.functions import checks, measures
from maskloom.functions.rx import EMAIL, find_spans, labelled_spans, render
from maskloom.operators import datasets, detect, fields, intervals, scoring, tokens
from maskloom.plans import fixtures as fx
from maskloom.plans.oracle import ORACLE_SQL  # noqa: F401
from maskloom.streaming import mask as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# --- detection and rendering ---


@query
def mask_regex_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.mask_regex(fx.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "masked_text", F.size("entities").alias("n_entities"))


def _email_spans(spark: SparkSession, sf_dir: str, name: str, key: list[str], text: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, name).select(*key, F.explode(find_spans(F.col(text), EMAIL)).alias("m"))
    return rows.select(*key, F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.value").alias("value"))


@query
def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _email_spans(spark, sf_dir, "documents", ["doc_id"], "text")


@query
def email_spans_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _email_spans(spark, sf_dir, "conversations", ["conv_id", "turn"], "text")


@query
def email_spans_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _email_spans(spark, sf_dir, "pages", ["page_id"], "html")


def _announcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = (F.col("o_custkey") % 90 + 10).cast("string")
    text = F.concat(F.lit("Passport number: C"), fx.digits("o_orderkey", 8), F.lit(", age: "), age, F.lit(" years. Order "), fx.digits("o_orderkey", 8), F.lit(" mail a@b.org"))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))


@query
def structured_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _announcing(spark, sf_dir).select("o_orderkey", F.explode(fields.announced("text")).alias("s"))
    return found.select("o_orderkey", "s.start", "s.end", "s.label", "s.context")


@query
def structured_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fields.mask_structured(_announcing(spark, sf_dir))
    return out.select("o_orderkey", "masked_text", "diagnostics.structured_candidates", "diagnostics.protected_candidates", "diagnostics.final_entities")


@query
def structured_mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.mask_structured(fx.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "masked_text", F.size("entities").alias("n_entities"))


@query
def render_adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("%s bought %s", F.col("c_name"), F.col("c_mktsegment"))
    n = F.length("c_name")
    pairs = F.array(F.struct(F.lit(0).alias("start"), (n - 3).alias("end"), F.lit("PERSONNAME").alias("label")), F.struct((n - 3).alias("start"), n.alias("end"), F.lit("USERNAME").alias("label")))
    return fx.table(spark, sf_dir, "customer").select("c_custkey", render(text, pairs).alias("masked_text"))


# --- checksums ---


@query
def iban_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("37040044"), fx.digits("c_custkey", 10))
    check = F.lpad((98 - checks.mod97(F.concat(body, F.lit("DE00")))).cast("string"), 2, "0")
    value = F.concat(F.lit("DE"), F.when(F.col("c_custkey") % 2 == 0, check).otherwise("11"), body)
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", value.alias("iban"))
    return rows.select("c_custkey", "iban", checks.iban_valid(F.col("iban")).alias("is_valid"), checks.iban_status(F.col("iban")).alias("status"))


@query
def luhn_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), F.lit(0))).alias("nth", "digits"))
    return found.select("doc_id", "nth", "digits", checks.luhn_valid(F.col("digits")).alias("is_valid"))


@query
def dni_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.substring(F.lit(checks.DNI_LETTERS), (F.col("o_custkey") % 23 + 1).cast("int"), F.lit(1))
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(fx.digits("o_orderkey", 8), letter).alias("value"))
    return rows.select("o_orderkey", "value", checks.dni_status(F.col("value")).alias("status"))


@query
def nie_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.substring(F.lit(checks.DNI_LETTERS), (F.col("o_custkey") % 23 + 1).cast("int"), F.lit(1))
    lead = F.substring(F.lit("XYZ"), (F.col("o_orderkey") % 3 + 1).cast("int"), F.lit(1))
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(lead, fx.digits("o_orderkey", 7), letter).alias("value"))
    return rows.select("o_orderkey", "value", checks.dni_status(F.col("value")).alias("status"))


@query
def codice_fiscale_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    abc = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    at = lambda x: F.substring(abc, (x % 26 + 1).cast("int"), F.lit(1))
    value = F.concat(F.lit("RSSMR"), at(key), F.lpad((key % 100).cast("string"), 2, "0"), F.lit("A"), F.lpad((key % 31 + 1).cast("string"), 2, "0"), F.lit("H"), F.lpad((key % 1000).cast("string"), 3, "0"), at(F.col("o_custkey")))
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value"))
    return rows.select("o_orderkey", "value", checks.fiscal_status(F.col("value")).alias("status"))


@query
def nir_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("18505"), F.when(F.col("o_orderkey") % 5 == 0, "2A").otherwise("75"), fx.digits("o_orderkey", 6))
    plain = F.replace(body, F.lit("2A"), F.lit("19")).cast("bigint")
    key = F.when(F.col("o_custkey") % 2 == 0, 97 - plain % 97).otherwise(F.col("o_custkey") % 97)
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(body, F.lpad(key.cast("string"), 2, "0")).alias("value"))
    return rows.select("o_orderkey", "value", checks.nir_status(F.col("value")).alias("status"))


@query
def steuer_idnr_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("8609"), fx.digits("o_orderkey", 6), (F.col("o_custkey") % 10).cast("string")).alias("value"))
    return rows.select("o_orderkey", "value", checks.steuer_idnr_status(F.col("value")).alias("status"))


@query
def nino_ssn_ahv_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pair = F.substring(F.lit("ABBGCEGBJKTN"), (key % 6 * 2 + 1).cast("int"), F.lit(2))
    rows = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(pair, F.lpad((key % 1000000).cast("string"), 6, "0"), F.lit("C")).alias("nino"),
        F.concat_ws("-", F.lpad((key % 1000).cast("string"), 3, "0"), F.lpad((key % 100).cast("string"), 2, "0"), F.lpad((key % 10000).cast("string"), 4, "0")).alias("ssn"),
        F.concat(F.lit("756"), fx.digits("o_orderkey", 10)).alias("ahv"),
    )
    return rows.select("*", checks.nino_status(F.col("nino")).alias("nino_status"), checks.ssn_status(F.col("ssn")).alias("ssn_status"), checks.ahv_status(F.col("ahv")).alias("ahv_status"))


@query
def id_detectors_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors on texts that hold a valid and an invalid DNI, SSN and NINO each."""
    key = F.col("o_orderkey")
    letter = F.substring(F.lit(checks.DNI_LETTERS), (key % 23 + 1).cast("int"), F.lit(1))
    text = F.concat(F.lit("id "), fx.digits("o_orderkey", 8), letter, F.lit(", ssn 123-45-"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("; nino AB123456C."))
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    found = rows.select("o_orderkey", F.explode(detect.identifier_spans(F.col("text"), tuple(detect.DETECTORS))).alias("s"))
    return found.select("o_orderkey", "s.start", "s.end", "s.label", "s.detector")


# --- interval algebra ---


@query
def structured_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.dedupe_detections(fx.spans(spark, sf_dir)).select("doc", "start", "end", "label")


@query
def union_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_touching(fx.spans(spark, sf_dir))


@query
def union_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_strict(fx.spans(spark, sf_dir))


@query
def union_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_per_label(fx.spans(spark, sf_dir))


@query
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_sources(fx.spans(spark, sf_dir))


@query
def union_label_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union_promoted(fx.spans(spark, sf_dir))


@query
def union_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.spans(spark, sf_dir)
    return intervals.union_refined(s.withColumn("source", F.when(F.col("ord") == 4, "refine").otherwise(F.col("source"))))


@query
def region_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address [0, 60) of each order, cut at the other values in it."""
    inside = intervals.union_promoted(fx.spans(spark, sf_dir)).where("start < 60")
    rows = inside.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("overrides"))
    parts = rows.select("doc", F.explode(tokens.split_region(F.lit(0), F.lit(60), F.col("overrides"))).alias("p"))
    return parts.select("doc", "p.start", "p.end", "p.label")


@query
def greedy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.spans(spark, sf_dir).groupBy("doc").agg(F.collect_list(F.struct("start", "end", "label")).alias("spans"))
    return rows.select("doc", F.explode(intervals.greedy(F.col("spans"))).alias("s")).select("doc", "s.start", "s.end", "s.label")


@query
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intersect(fx.gold(spark, sf_dir), fx.predicted(spark, sf_dir))


@query
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.subtract(fx.gold(spark, sf_dir), fx.predicted(spark, sf_dir))


@query
def complement_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(80).alias("n"))
    return intervals.complement(fx.spans(spark, sf_dir).where("end <= 80"), lengths)


@query
def overlap_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_join(fx.gold(spark, sf_dir).select("doc", "start", "end"), fx.predicted(spark, sf_dir).select("doc", "start", "end")).drop("r_doc")


@query
def rules_first_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.spans(spark, sf_dir).select("doc", "start", "end", "label", "source")
    return intervals.rules_first(s.where("source = 'regex'"), s.where("source = 'mbert'"))


@query
def containment_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.contained(fx.gold(spark, sf_dir).select("doc", "start", "end"), fx.predicted(spark, sf_dir))


# --- scores ---


@query
def span_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.with_hits(fx.scored_documents(spark, sf_dir)).select("doc_id", "pred", F.explode("scored").alias("g"))
    g = F.col("g")
    kind = scoring.span_class(g["start"], g["end"], g["label"], F.col("pred"), g["covered"])
    return rows.select("doc_id", g["start"].alias("start"), g["end"].alias("end"), g["label"].alias("label"), kind.alias("category"))


@query
def masking_report_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_ratios(scoring.totals(scoring.document_counts(fx.scored_documents(spark, sf_dir))))


@query
def masking_report_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.totals(scoring.document_counts(fx.scored_documents(spark, sf_dir)), "lang")


@query
def masking_report_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.by_label(fx.scored_documents(spark, sf_dir))


@query
def external_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = scoring.external_counts(fx.scored_documents(spark, sf_dir))
    names = [c for c in counts.columns if c not in ("doc_id", "lang", "text", "gold", "pred")]
    out = counts.groupBy("lang").agg(*(F.sum(c).alias(c) for c in names))
    return out.select("*", F.round(measures.percent(F.col("covered_gold_alnum"), F.col("gold_alnum")), 9).alias("coverage_pct"), F.round(measures.percent(F.col("excess_masked_chars"), F.col("non_annotated_chars")), 9).alias("excess_pct"))


@query
def out_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words before a stop are out of scope; words in -ing are masked."""
    rows = fx.scored_documents(spark, sf_dir).withColumnRenamed("pred", "out_of_scope")
    rows = rows.withColumn("pred", labelled_spans(F.col("text"), "[A-Za-z]*ing", "USERNAME"))
    return scoring.out_of_scope_counts(rows).groupBy("lang").agg(F.sum("out_of_scope_alnum").alias("out_of_scope_alnum"), F.sum("masked_alnum").alias("masked_alnum"))


@query
def top_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.table(spark, sf_dir, "conversations").select(F.col("role").alias("label"), "text", F.explode(find_spans(F.col("text"), "[A-Za-z0-9][A-Za-z0-9.@]*")).alias("m"))
    pieces = found.select("label", measures.shape(F.col("text"), F.col("m.start"), F.col("m.end")).alias("shape"), F.length("m.value").alias("chars"))
    return scoring.top_shapes(pieces)


@query
def streaming_mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masking projection over the documents as a stream of files, read back from its sink."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="maskloom-")
    at = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    docs = stream.read_documents(spark, f"{sf_dir}/documents.parq*")
    stream.write_masked(stream.mask_stream(docs).select("doc_id", "masked_text", F.size("entities").alias("n_entities")), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("doc_id bigint, masked_text string, n_entities int").parquet(f"{at}/out")


@query
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = fx.table(spark, sf_dir, "documents").select("doc_id", "source").join(fx.table(spark, sf_dir, "labels"), "doc_id")
    g = joined.groupBy("source").agg(F.sum("quality").alias("successes"), F.count("quality").alias("total"))
    rate, low, high = measures.wilson(F.col("successes"), F.col("total"))
    return g.select("source", "successes", "total", F.round(rate, 9).alias("rate"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query
def strict_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scoring.strict_matches(fx.spans(spark, sf_dir, "l_suppkey % 5 < 3"), fx.spans(spark, sf_dir, "l_suppkey % 5 > 1"))
    p, r, f = measures.f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return m.select("label", "tp", "fp", "fn", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f, 9).alias("f1"))


@query
def constrained_argmax_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("setting"), (F.col("s_suppkey") * 37 % 101).alias("coverage"), (F.col("s_suppkey") * 53 % 29).alias("excess"))
    return scoring.best_setting(grid, F.col("excess") <= 12, F.desc("coverage"), F.asc("excess"), F.asc("setting"))


@query
def shape_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fx.table(spark, sf_dir, "documents").select("text", F.explode(find_spans(F.col("text"), "[A-Za-z0-9][A-Za-z0-9.@]*")).alias("m"))
    pieces = found.select(measures.shape(F.col("text"), F.col("m.start"), F.col("m.end")).alias("shape"), F.length("m.value").alias("chars"))
    return pieces.groupBy("shape").agg(F.count("*").alias("pieces"), F.sum("chars").alias("chars"))


# --- tokens ---


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.blank_tokens(fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text"))


@query
def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.size(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("n"))
    return tokens.window_bounds(docs)


@query
def bio_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    spans = docs.select("doc", F.posexplode(find_spans(F.col("text"), "[A-Z][a-z]+[.,] [A-Z]?[a-z]+")).alias("ord", "m"))
    spans = spans.select("doc", "ord", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.lit("PERSONNAME").alias("label"))
    return tokens.bio_encode(tokens.blank_tokens(docs), spans).groupBy("doc", "tag").agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query
def bio_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.element_at(F.array(*(F.lit(x) for x in ("O", "B-EMAIL", "I-EMAIL", "I-IBAN", "I-IBAN", "B-IBAN", "O"))), (F.col("pos") * F.col("doc") % 7 + 1).cast("int"))
    t = _tokens(spark, sf_dir).withColumn("tag", tag).withColumn("start", F.when(F.col("pos") % 11 != 10, F.col("start")))
    return tokens.bio_decode(t, ["doc"])


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows of line items by their number, spans from the suppliers of the same order."""
    t = fx.spans(spark, sf_dir).withColumn("win", (F.col("ord") > 3).cast("int"))
    spans = fx.gold(spark, sf_dir).groupBy("doc", "ord").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return tokens.window_geometry(t, spans)


@query
def window_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _geometry(spark, sf_dir)


@query
def window_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.fully_covered(_geometry(spark, sf_dir))


@query
def text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return datasets.ordered_digest(docs.select(datasets.text_hash(F.col("text")).alias("h")), "h")


NAMES = ["O", "B-PERSONNAME", "I-PERSONNAME", "B-EMAIL", "I-EMAIL"]


def _probabilities(first: int):
    return F.transform(F.slice("embedding", F.lit(first), F.lit(5)), lambda x: F.abs(x.cast("double")))


@query
def argmax_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag, conf = tokens.winner(_probabilities(1), NAMES)
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", tag.alias("tag"), F.round(conf, 9).alias("conf"))


@query
def name_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag, conf = tokens.winner(_probabilities(1), NAMES, 0.2)
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", tag.alias("tag"), F.round(conf, 9).alias("conf"))


@query
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag, conf = tokens.winner(tokens.average(_probabilities(1), _probabilities(6)), NAMES)
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", tag.alias("tag"), F.round(conf, 9).alias("conf"))


@query
def ensemble_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    (t1, c1), (t2, c2) = tokens.winner(_probabilities(1), NAMES), tokens.winner(_probabilities(6), NAMES)
    tag, conf = tokens.union_tags(t1, c1, t2, c2)
    return fx.table(spark, sf_dir, "embeddings").select("vec_id", tag.alias("tag"), F.round(conf, 9).alias("conf"))


@query
def min_score_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector is a window of 12 tokens over the text of its label."""
    pos = F.sequence(F.lit(0), F.lit(11))
    rows = fx.table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("doc"), F.col("vec_id").alias("win"), "embedding", F.explode(pos).alias("pos"))
    tag, conf = tokens.winner(F.transform(F.slice("embedding", F.col("pos") + 1, F.lit(5)), lambda x: F.abs(x.cast("double"))), NAMES)
    t = rows.select("doc", "win", "pos", (F.col("pos") * 4).alias("start"), (F.col("pos") * 4 + 3).alias("end"), tag.alias("tag"), conf.alias("conf"))
    return tokens.window_spans(t).select("doc", "start", "end", "label", F.round("conf", 9).alias("conf"))


# --- data sets ---


@query
def hash_topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.hash_topk(fx.table(spark, sf_dir, "documents"), 20, "lang", "doc_id").select("lang", "doc_id", "text_sha256", "rank")


@query
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.hash_sample(fx.table(spark, sf_dir, "documents"), 100, "doc_id").select("doc_id", "text_sha256")


@query
def text_hash_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return datasets.without_texts_of(docs.where("source <> 'src0'"), docs.where("source = 'src0'")).select("doc_id", "source")


@query
def contamination_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return datasets.shared_texts(docs.where("lang = 'en'"), docs.where("source in ('src0', 'src1', 'src2')"))


@query
def disjoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = datasets.shared_texts(fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "benchmark"))
    return shared.agg(F.count("*").alias("shared"))


@query
def conflicting_duplicate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.conflicting_texts(fx.table(spark, sf_dir, "documents"), F.col("source"))


@query
def dataset_summary_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    n = F.size(F.regexp_extract_all("text", F.lit(fx.SHORT), F.lit(0)))
    return datasets.summary_cube(docs.select("source", "lang", n.alias("n_spans")), "source", "lang")


@query
def run_ledger_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = fx.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("profile"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("model_sha256")).distinct()
    profile = F.when(F.col("c_mktsegment") == "BUILDING", "1-URGENT").when(F.col("c_mktsegment") == "AUTOMOBILE", "2-HIGH").otherwise("3-MEDIUM")
    ledger = fx.table(spark, sf_dir, "customer").select(profile.alias("profile"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("model_sha256"))
    return datasets.not_yet_run(wanted, ledger, ["profile", "model_sha256"])
