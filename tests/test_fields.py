"""Announced values: positives by language, negatives, and the staged mask, in batch, in SQL and on a stream."""

import pytest

from maskloom.operators.fields import field_spans, mask_structured, phone_possible, register_functions
from maskloom.operators.detect import mask_regex
from maskloom.streaming.mask import mask_stream, read_documents, write_masked


def values(text):
    return [(text[a:b], label) for a, b, label, _ in field_spans(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Passport number: C01X00T47.", [("C01X00T47", "PASSPORTNUM")]),
        ("Reisepassnummer: C01X00T47, danke", [("C01X00T47", "PASSPORTNUM")]),
        ("Numéro de sécurité sociale : 1 85 05 78 006 084 91", [("1 85 05 78 006 084 91", "SOCIALNUM")]),
        ("Codice fiscale: RSSMRA85T10A562S fine", [("RSSMRA85T10A562S", "TAXNUM")]),
        ("cuenta bancaria: 2100 0418 4502 0005 1332 gracias", [("2100 0418 4502 0005 1332", "ACCOUNTNUM")]),
        ("Geburtsdatum: 03.05.1985", [("03.05.1985", "DATEOFBIRTH")]),
        ("née le 3 mai 1985 à Lyon", [("3 mai 1985", "DATEOFBIRTH")]),
        ("Age: 42 years", [("42 years", "AGE")]),
        ("Telefon: 030 1234567 ext. 12", [("030 1234567 ext. 12", "TELEPHONENUM")]),
        ("call +49 30 1234567 now", [("+49 30 1234567", "TELEPHONENUM")]),
        ("IBAN de89 3704 0044 0532 0130 00 ok", [("de89 3704 0044 0532 0130 00", "IBAN")]),
        ("customer: ABC-12345: next", []),
        ("passport: none given", []),
        ("order 4471-2290, invoice 2024/118", []),
        ("product age 3 years", []),
        ("the machine's age: 12", []),
        ("permis: 12AB34567", []),
        ("Mon permis n° 12AB34567 ok", [("12AB34567", "DRIVERLICENSENUM")]),
        ("passport C01X00T47 and permit: 12AB34567", [("C01X00T47", "PASSPORTNUM"), ("12AB34567", "DRIVERLICENSENUM")]),
        ("dossier 12345", []),
        ("dossier: 12345-A", [("12345-A", "PERSONALREF")]),
        ("geboren am 3. Mai 1985", [("3. Mai 1985", "DATEOFBIRTH")]),
        ("born on May 3, 1985.", [("May 3, 1985", "DATEOFBIRTH")]),
        ("invoice number: 030 1234 5678", []),
        ("call 030 1234 5678 today", [("030 1234 5678", "TELEPHONENUM")]),
        ("part AB-030 1234 5678", []),
        ("", []),
    ],
)
def test_announced_values(text, want):
    assert values(text) == want


def test_identifiers_after_business_keys_stay(spark):
    texts = ["order: RSSMRA85T10A562S", "invoice number: 1 85 05 78 006 084 91", "Bestellung RSSMRA85T10A562S", "reorder RSSMRA85T10A562S", "client RSSMRA85T10A562S"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["masked_text"] for r in mask_structured(rows).collect()}
    assert [got[i] for i in range(5)] == [*texts[:3], "reorder [TAXNUM]", "client [PERSONALREF]"]


def test_phone_plan():
    assert phone_possible("+33 1 23 45 67 89")
    assert not phone_possible("+33 1 23")


def test_staged_mask(spark):
    rows = [(1, "Mail jo@ex.org, passport: C01X00T47"), (2, None), (3, "clean"), (4, "id 1 85 05 78 006 084 91.")]
    got = {r["doc_id"]: r for r in mask_structured(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["masked_text"] == "Mail [EMAIL], passport: [PASSPORTNUM]"
    assert got[1]["diagnostics"]["protected_candidates"] == 1
    assert got[2]["masked_text"] == "" and got[2]["entities"] == []
    assert got[3]["masked_text"] == "clean"
    assert got[4]["masked_text"] == "id [SOCIALNUM]."


def test_sql_function(spark):
    register_functions(spark)
    assert spark.sql("SELECT pii_fields('passport: C01X00T47') AS f").first()["f"][0]["label"] == "PASSPORTNUM"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    write_masked(mask_stream(read_documents(spark, f"{tmp_path}/in")).select("doc_id", "masked_text"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.exceptAll(mask_regex(docs).select("doc_id", "masked_text")).count() == 0
    assert got.count() == docs.count()
