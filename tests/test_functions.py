"""Golden values of functions and interval rules."""

import pytest
from pyspark.sql import functions as F

from maskloom.functions import checks, measures
from maskloom.functions.rx import EMAIL, find_spans, render
from maskloom.operators import detect, intervals, tokens


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("out")).first()["out"]


def test_offsets_count_code_points(spark):
    got = one(spark, find_spans(F.col("t"), EMAIL), t="A😀 a@b.co, x@y.org z")
    assert [(m["start"], m["end"]) for m in got] == [(3, 9), (11, 18)]


def test_many_matches_keep_their_offsets(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    got = one(spark, find_spans(F.col("t"), "[a-z][0-9]+"), t=text)
    assert len(got) == 1000
    assert all(text[m["start"] : m["end"]] == m["value"] for m in got)


def test_null_text_has_no_spans(spark):
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(find_spans(F.col("t"), EMAIL)).first()[0] == []


@pytest.mark.parametrize(
    ("text", "masked"),
    [("write to jo@ex.org now", "write to [EMAIL] now"), ("GB82 WEST 1234 5698 7654 32", "[IBAN]"), ("GB83 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32"), ("", ""), ("nothing here", "nothing here")],
)
def test_regex_engine(spark, text, masked):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert detect.mask_regex(df).first()["masked_text"] == masked


def test_render_of_adjacent_spans(spark):
    spans = F.expr("array(named_struct('start', 0, 'end', 2, 'label', 'A'), named_struct('start', 2, 'end', 3, 'label', 'B'))")
    assert one(spark, render(F.col("t"), spans), t="xyz!") == "[A][B]!"


@pytest.mark.parametrize(
    ("value", "label", "status"),
    [
        ("DE89 3704 0044 0532 0130 00", "IBAN", "valid"), ("DE88 3704 0044 0532 0130 00", "IBAN", "invalid"), ("XX89 3704 0044 0532", "IBAN", "unknown"),
        ("4111 1111 1111 1111", "CREDITCARDNUMBER", "valid"), ("4111 1111 1111 1112", "CREDITCARDNUMBER", "invalid"), ("12345678Z", "IDCARDNUM", "valid"), ("12345678A", "IDCARDNUM", "invalid"),
        ("X1234567L", "TAXNUM", "valid"), ("RSSMRA85T10A562S", "TAXNUM", "valid"), ("RSSMRA85T10A562T", "TAXNUM", "invalid"), ("123-45-6789", "SOCIALNUM", "valid"), ("666-45-6789", "SOCIALNUM", "invalid"),
        ("756.9217.0769.85", "SOCIALNUM", "valid"), ("756.9217.0769.86", "SOCIALNUM", "invalid"), ("C01X00T47", "PASSPORTNUM", "valid"), ("A1", "PASSPORTNUM", "invalid"), ("123456", "EMAIL", "n/a"),
    ],
)
def test_identifier_status(spark, value, label, status):
    assert one(spark, checks.identifier_status(F.col("v"), F.col("l")), v=value, l=label) == status


def test_german_tax_number(spark):
    assert one(spark, checks.steuer_idnr_status(F.col("v")), v="86095742719") == "valid"
    assert one(spark, checks.steuer_idnr_status(F.col("v")), v="86095742710") == "invalid"


def test_touching_spans_merge_only_where_the_rule_says(spark):
    df = spark.createDataFrame([(1, 0, 3, "A"), (1, 3, 5, "B"), (1, 4, 8, "B")], "doc long, start int, end int, label string")
    assert [tuple(r) for r in intervals.union_touching(df).collect()] == [(1, 0, 8)]
    assert sorted((r["start"], r["end"], r["label"]) for r in intervals.union_strict(df).collect()) == [(0, 3, "A"), (3, 8, "B")]


def test_enclosing_region_takes_the_label(spark):
    df = spark.createDataFrame([(1, 1, 2, "CUSTOM"), (1, 1, 5, "PERSONNAME"), (1, 4, 7, "SURNAME")], "doc long, start int, end int, label string")
    assert [(r["start"], r["end"], r["label"]) for r in intervals.union_promoted(df).collect()] == [(1, 7, "PERSONNAME")]


def test_greedy_drops_later_overlaps(spark):
    df = spark.sql("SELECT array(named_struct('start', 2, 'end', 6, 'label', 'B'), named_struct('start', 0, 'end', 3, 'label', 'A'), named_struct('start', 3, 'end', 4, 'label', 'C')) AS s")
    assert [(r["start"], r["label"]) for r in df.select(intervals.greedy(F.col("s"))).first()[0]] == [(0, "A"), (3, "C")]


def test_union_of_two_taggers(spark):
    names = ["O", "B-PERSONNAME", "I-PERSONNAME", "B-EMAIL"]
    a = [[0.9, 0.1, 0.0, 0.0], [0.6, 0.4, 0.0, 0.0], [0.2, 0.0, 0.3, 0.5], [0.4, 0.0, 0.0, 0.6]]
    b = [[0.8, 0.1, 0.1, 0.0], [0.3, 0.7, 0.0, 0.0], [0.7, 0.0, 0.3, 0.0], [0.1, 0.0, 0.0, 0.9]]
    df = spark.createDataFrame(list(zip(range(4), a, b, strict=True)), "i int, a array<double>, b array<double>")
    (t1, c1), (t2, c2) = tokens.winner(F.col("a"), names), tokens.winner(F.col("b"), names)
    assert [r[0] for r in df.orderBy("i").select(tokens.union_tags(t1, c1, t2, c2)[0]).collect()] == ["O", "B-PERSONNAME", "B-EMAIL", "B-EMAIL"]


def test_wilson_of_nothing_is_null(spark):
    rate, low, high = measures.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(rate, low, high).first()) == (None, None, None)


def test_split_region_covers_the_region(spark):
    df = spark.sql("SELECT 2 AS a, 20 AS b, array(named_struct('start', 5, 'end', 8, 'label', 'EMAIL'), named_struct('start', 8, 'end', 10, 'label', 'EMAIL'), named_struct('start', 18, 'end', 30, 'label', 'TELEPHONENUM')) AS o")
    got = [tuple(r) for r in df.select(tokens.split_region(F.col("a"), F.col("b"), F.col("o"))).first()[0]]
    assert got == [(2, 5, "ADDRESS"), (5, 10, "EMAIL"), (10, 18, "ADDRESS"), (18, 20, "TELEPHONENUM")]
