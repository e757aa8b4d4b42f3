import pytest
from pyspark.sql import functions as F

from fieldscan.functions import names
from fieldscan.functions.dictionary import FREE_TEXT_NAMES, name_dictionary, ner_labels
from fieldscan.functions.taxonomy import (
    ENTITY_TAG,
    TAG_PRIORITY,
    TAGS,
    clamp_layer,
    confidence_tier,
    primary_tag,
    tag_definitions,
    tag_of,
)
from fieldscan.functions.text import leaf_name, name_words, schema_path
from fieldscan.operators.detect import classify_names, detect, explode_detections, with_name_columns

EXPECTED = {
    "GOVERNMENT_ID": "ssn social_security passport_number driver_license driverLicense nin au_tfn socialSecurityNumber SSNValue",
    "PHI": "mrn medical_record_id patient_id diagnosis medication npi dea_number health_insurance_id icd10Code",
    "BIOMETRIC": "fingerprint facial_recognition retina_scan",
    "GENETIC": "dna_sequence genome",
    "PCI": "credit_card_number creditCardNumber iban swift_code crypto_wallet",
    "FINANCIAL": "account_number bank_account routing_number",
    "CREDENTIALS": "password api_key jwt access_token private_key connection_string session_token",
    "PII": "email email_address emailAddress phone_number first_name firstName date_of_birth dob gender c_name",
    "LOCATION": "ip_address home_address IPAddress order_state billing-city",
    "MINOR": "child_id minor_data",
    "NPI": "mnpi earnings_forecast",
}
SILENT = ["id", "value", "data", "ref", "nickname", "tax_id", "national_id", "emergency_contact", "transaction_amount", "passwords", ""]


@pytest.fixture(scope="module")
def hits(spark):
    names = [n for group in EXPECTED.values() for n in group.split()] + SILENT + ["user_name", "a.b[0].email", "tags[12]"]
    rows = with_name_columns(spark.createDataFrame([(n,) for n in names], "field_path string")).collect()
    return {r["field_path"]: [(h["entity_type"], h["tag"], h["score"]) for h in r["name_hits"]] for r in rows}


def test_every_known_name_gets_its_tag(hits):
    for tag, names in EXPECTED.items():
        for name in names.split():
            assert tag in {h[1] for h in hits[name]}, name


def test_other_names_stay_silent(hits):
    assert {n: hits[n] for n in SILENT if hits[n]} == {}


def test_best_score_first_and_several_entities(hits):
    assert hits["user_name"] == [("USERNAME", "PII", 0.85), ("PERSON", "PII", 0.82)]
    assert hits["a.b[0].email"][0][0] == "EMAIL_ADDRESS"
    assert hits["tags[12]"] == []


def test_join_form_agrees_with_expression(spark, hits):
    rows = classify_names(spark.createDataFrame([(n,) for n in hits], "field_path string")).collect()
    joined = {}
    for r in rows:
        joined.setdefault(r["name"], set()).add((r["entity_type"], r["tag"], r["score"]))
    assert joined == {n: set(h) for n, h in hits.items() if h}
    assert {r["matched_keyword"] for r in rows if r["name"] == "socialSecurityNumber"} == {"social_security"}


def test_names_take_new_dictionary_rows(spark):
    df = spark.createDataFrame([("badge_color",)], "field_path string")
    found = with_name_columns(df, [*name_dictionary(), ("BADGE", 0.5, ["badge_color"])]).first()["name_hits"]
    assert [(h["entity_type"], h["tag"]) for h in found] == [("BADGE", "PII")]


def test_words_and_paths(spark):
    df = spark.createDataFrame([("a.items[0].SSNValue",), ("[3]",), ("x.icd10Code",), ("p.9lives[2]",)], "p string")
    got = [tuple(r) for r in df.select(leaf_name("p"), name_words(leaf_name(F.col("p"))), schema_path(F.col("p")), schema_path(F.col("p"), True)).collect()]
    assert got == [
        ("SSNValue", "ssn value", "a.items.SSNValue", "a.items.0.SSNValue"),
        ("", "", "", "3"),
        ("icd10Code", "icd10 code", "x.icd10Code", "x.icd10Code"),
        ("lives", "lives", "p.9lives", "p.9lives.2"),
    ]


def test_free_text(spark):
    sentence = "approved after the third manual review today"
    cases = [(n, "test", True) for n in FREE_TEXT_NAMES]
    cases += [(n, sentence, False) for n in ("email", "ssn", "credit_card", "password", "account_number")]
    cases += [("info", sentence, True), ("info", "approved", False), ("info", "a\tb\tc\td\te\tf", False), ("info", " a b  c d\ne f ", True)]
    df = spark.createDataFrame([(i, n, v) for i, (n, v, _) in enumerate(cases)], "i int, field_path string, value string")
    got = {r["i"]: r["is_free_text"] for r in detect(df, 1).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_name_detection_shape(spark):
    df = spark.createDataFrame([("x", "user.email", "v" * 100)], "id string, field_path string, value string")
    d = explode_detections(detect(df, 1)).first()
    assert (d["start"], d["end"], len(d["text_snippet"]), d["layer"], d["source"], d["rank"]) == (0, 100, 80, 1, "field_name", 0)


def test_taxonomy(spark):
    assert len(TAGS) == 11 and len(ENTITY_TAG) == 46 and set(ENTITY_TAG.values()) == set(TAGS) == set(TAG_PRIORITY)
    assert len(name_dictionary()) == 44 and len(ner_labels()) == 91 and set(ner_labels().values()) <= set(ENTITY_TAG)
    assert tag_definitions(spark).count() == 11
    df = spark.createDataFrame([("IBAN_CODE", 0.85, 9), ("nonsense", 0.6, None), ("", 0.59, 0)], "e string, s double, n int")
    got = [tuple(r) for r in df.select(tag_of(F.col("e")), confidence_tier(F.col("s")), clamp_layer(F.col("n"))).collect()]
    assert got == [("PCI", "HIGH", 3), ("PII", "MEDIUM", 3), ("PII", "LOW", 1)]
    tags = spark.sql("SELECT array('PII','PCI','PHI') a, array('MINOR') b, array() c").first()
    assert [spark.createDataFrame([(list(t),)], "t array<string>").select(primary_tag(F.col("t"))).first()[0] for t in tags] == ["PHI", "MINOR", None]


def test_keywords_are_looked_up_among_few(spark):
    words = names.keyword_lookup()
    parted = names.by_length(words)
    assert {w: h for few in parted for w, h in few.items()} == words
    assert all(len(w) == n for n, few in enumerate(parted) for w in few) and max(map(len, parted)) * 4 < len(words)
    named = spark.createDataFrame([(w,) for w in [*words, "none of these"]], "words string")
    found = {r["words"]: {h["entity_type"] for h in r["hits"]} for r in named.select("words", names.name_hits(F.col("words")).alias("hits")).collect()}
    assert all({h["entity_type"] for h in hits} <= found[w] for w, hits in words.items()) and not found["none of these"]
