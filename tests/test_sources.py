"""Labelled rows and their faults, external tables, receipts."""

import json

import pytest

from maskloom.sources import tables


def test_labelled_rows(spark, tmp_path):
    good = {"case_id": "a", "family": "names", "gold": [{"start": 0, "end": 2, "label": "AGE"}], "language": "en", "split": "dev", "text": "42 years"}
    rows = [good, good | {"case_id": "b", "text": "43 years", "gold": [{"start": 0, "end": 99, "label": "AGE"}]}, good | {"case_id": "c", "language": "xx", "text": "x"}, good | {"case_id": "d", "split": "train", "text": "y"}, good | {"case_id": "e", "gold": [], "text": "clash"}, good | {"case_id": "f", "text": "clash"}, good | {"case_id": "g", "text": "z1"}, good | {"case_id": "g", "text": "z2"}]
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    kept, bad = tables.read_labelled(spark, str(path), "dev")
    assert [r["case_id"] for r in kept.collect()] == ["a"]
    assert sorted({(r["case_id"], r["fault"]) for r in bad.collect()}) == [("b", "gold_invalid"), ("c", "language_invalid"), ("d", "split_invalid"), ("e", "text_conflict"), ("f", "text_conflict"), ("g", "case_id_repeated")]


def test_external_rows(spark, tmp_path):
    spans = '[{"start":0,"end":2,"label":"name"},{"start":3,"end":5,"label":"date"}]'
    spark.createDataFrame([("en", "ab cd", spans, 1)], "language string, generated_text string, pii_spans string, other int").write.parquet(f"{tmp_path}/x")
    row = tables.read_external(spark, f"{tmp_path}/x", {"name": "PERSONNAME"}, ("date",)).first()
    assert [g["label"] for g in row["gold"]] == ["PERSONNAME"]
    assert [g["label"] for g in row["out_of_scope"]] == ["date"]


def test_routed_rows(spark, tmp_path):
    mask = lambda start, end, value: [{"start": start, "end": end, "label": "CITY", "value": value}]
    rows = [("en", "in Rome", mask(3, 7, "Rome")), ("en", "😀 Rome", mask(2, 6, "Rome")), ("de", "in Rom", mask(0, 2, "Rom")), ("xx", "y", []), ("de", "leer", []), ("en", None, []), ("en", "short", mask(3, 9, "rt"))]
    path = tmp_path / "rows.jsonl"
    path.write_text("".join(json.dumps({"language": a, "source_text": b, "privacy_mask": c, "more": 1}) + "\n" for a, b, c in rows))
    good, bad = tables.read_routed(spark, str(path), ("de", "en"))
    assert sorted(r["source_text"] for r in good.collect()) == ["in Rome", "leer", "😀 Rome"]
    assert sorted(str(r["source_text"]) for r in bad.collect()) == ["None", "in Rom", "short"]


def test_receipts(spark, tmp_path):
    rows = spark.range(10).selectExpr("id AS row", "array(id) AS entities")
    assert tables.verified_receipts(rows, f"{tmp_path}/r").count() == 0
    with pytest.raises(Exception, match="(?i)exists"):
        tables.verified_receipts(rows, f"{tmp_path}/r")
