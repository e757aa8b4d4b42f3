import json

import pytest
from pyspark.sql import functions as F

from fieldscan.operators import rollup, routing
from fieldscan.operators.detect import detect, explode_detections
from fieldscan.operators.entities import available, filter_entities, gazetteer, gazetteer_patterns, predictor, rejected_phrases
from fieldscan.operators.members import bloom_bits, maybe_in, reference_hits, value_digest
from fieldscan.plans.classify import classify, classify_fields
from fieldscan.plans.sql import create_classify_function, create_detection_view

# A record, the depth it is classified to, and a tag it must get (none: no tag at all).
CASES = [
    ({"socialSecurity": "-"}, 1, "GOVERNMENT_ID"),
    ({"contactEmail": "-"}, 1, "PII"),
    ({"db_pwd": "-"}, 1, "CREDENTIALS"),
    ({"card-no": "-"}, 1, "PCI"),
    ({"icd10": "-"}, 1, "PHI"),
    ({"q": "send it to aba 122105155 today"}, 2, "FINANCIAL"),
    ({"q": "paid by 5555 5555 5555 4444"}, 2, "PCI"),
    ({"q": "ask goran@post.example first"}, 2, "PII"),
    ({"remark": "Told us that the Psoriasis came back after the Omeprazole"}, 3, "PHI"),
    ({"q": "5555555555554444"}, 1, None),
    ({"order": {"buyer": [{"emailAddress": "-"}]}}, 1, "PII"),
]

VERTICALS = {
    "shop": {
        "buyer": {"surname": "Dvorak", "email": "dvorak_1@mail.example", "mobile": "(212) 555-0188"},
        "paid": {"cardNumber": "5555555555554444", "iban": "NL91ABNA0417164300", "to": {"postal_code": "9000", "street": "Mill Lane 3"}},
    },
    "clinic": {"medicalRecord": "H004211", "ssn": "219-09-9999", "provider_id": "1993999998", "remark": "Was given Amoxicillin by Hanna."},
    "bank": {"acct_no": "000123456789", "aba": "122105155", "bic": "ABNANL2A", "owner": {"login": "elif.x"}},
    "ops": {"jwt": "eyJub25lIjoiMSJ9.eyJhIjoiYiJ9.c2ln", "databaseUrl": "mysql://root:pw@store/main", "ipaddr": "192.0.2.17"},
    "people": {"fullName": "Jonna Äkäs", "retina": "R-77", "genome": "GATTACA", "juvenile": "yes", "nonpublic": "merger talks", "passport": "XK0042137"},
}


@pytest.fixture(scope="module")
def verticals(spark):
    rows = [(k, "v", json.dumps(v)) for k, v in VERTICALS.items()]
    return spark.createDataFrame(rows, "msg_id string, topic string, value string")


def test_cases(spark):
    for layer in (1, 2, 3):
        cases = [(str(i), json.dumps(r)) for i, (r, depth, _) in enumerate(CASES) if depth == layer]
        got = {}
        for r in classify(spark.createDataFrame(cases, "msg_id string, value string"), ["msg_id"], layer).collect():
            got.setdefault(int(r["msg_id"]), set()).add(r["tag"])
            assert r["layer"] <= layer
        for i, (_, depth, tag) in enumerate(CASES):
            if depth == layer:
                assert (tag in got.get(i, set())) if tag else i not in got, CASES[i]


def test_depth_is_clamped_and_null_means_all(verticals):
    assert {r["layer"] for r in classify(verticals, ["msg_id"], 0).select("layer").distinct().collect()} == {1}
    assert {r["layer"] for r in classify(verticals, ["msg_id"], None).select("layer").distinct().collect()} == {1, 2, 3}


def test_matrix_of_verticals(verticals):
    got = {r["msg_id"]: {t for t in rollup.TAGS if r[t]} for r in rollup.tag_matrix(classify_fields(verticals, ["msg_id"], 2), "msg_id").collect()}
    assert got["shop"] >= {"PII", "PCI", "LOCATION"} and got["clinic"] >= {"PHI", "GOVERNMENT_ID"}
    assert got["bank"] >= {"FINANCIAL", "PCI", "PII"} and got["ops"] >= {"CREDENTIALS", "LOCATION"}
    assert got["people"] >= {"PII", "BIOMETRIC", "GENETIC", "MINOR", "NPI", "GOVERNMENT_ID"}


def test_row_and_rows_agree_on_the_best(verticals):
    inside = classify_fields(verticals, ["msg_id"], 3).select("msg_id", "field_path", "tag", "score", "layer")
    across = rollup.best_per_field_tag(classify(verticals, ["msg_id"], 3), ["msg_id"]).select("msg_id", "field_path", "tag", "score", "layer")
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, across.collect()))


def test_view_for_sql(spark, verticals):
    verticals.createOrReplaceTempView("raw_messages")
    create_detection_view(spark, "raw_messages", "detections", ["msg_id"], 2)
    assert spark.sql("SELECT tag FROM detections WHERE msg_id = 'ops' AND field_path = 'jwt'").first()[0] == "CREDENTIALS"


def test_table_function_for_sql(spark, verticals):
    verticals.createOrReplaceTempView("raw_messages")
    create_classify_function(spark, "tags_of")
    for depth in ("0", "2", "NULL"):
        found = spark.sql(f"SELECT m.msg_id, f.* FROM raw_messages m, LATERAL tags_of({depth}, m.value) AS f")
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
        same = classify_fields(verticals, ["msg_id"], None if depth == "NULL" else int(depth)).select(*found.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, same.collect()))
    assert spark.sql("SELECT * FROM tags_of(3, 'no json')").collect() == [] == spark.sql("SELECT * FROM tags_of(3, NULL)").collect()


def test_routing_keeps_every_readable_message(spark):
    df = spark.createDataFrame(
        [("1", "t", "k", '{"email":"a@b.com","x":{"ssn":"1"}}'), ("2", "t", "k", '{"n":1}'), ("3", "t", None, "oops")],
        "msg_id string, topic string, key string, value string",
    )
    routed = routing.route(df, ["msg_id"], 2)
    assert {r["msg_id"]: r["sink_topic"] for r in routed.collect()} == {"1": "classified-messages", "2": "classified-safe", "3": "classified-safe"}
    sent = {json.loads(r["value"])["payload"].get("email"): json.loads(r["value"]) for r in routing.envelopes(routed).collect()}
    assert len(sent) == 2
    body = sent["a@b.com"]["classification"]
    assert body["tags"] == ["GOVERNMENT_ID", "PII"] and set(body["detected_entities"]) == {"email", "x.ssn"}
    assert [e["layer"] for e in body["detected_entities"]["email"]] == [1, 2]
    assert sent[None]["classification"]["tags"] == [] and sent[None]["classification"]["detected_entities"] == {}
    audit = {r["msg_id"]: r["entity_types_found"] for r in routing.audit_rows(routed, ["msg_id"]).collect()}
    assert audit["1"] == ["EMAIL_ADDRESS", "US_SSN"] and audit["2"] == []


def test_two_spellings_of_one_path(spark):
    df = spark.createDataFrame([("1", "k", '{"a.email":"x","a":{"email":"b@c.de"}}')], "msg_id string, key string, value string")
    row = routing.route(df, ["msg_id"], 2).first()
    assert [e["layer"] for e in row["detected_entities"]["a.email"]].count(1) == 2 and row["tags"] == ["PII"]


def test_tag_list_keeps_repeats(spark):
    rows = spark.createDataFrame([("k", "PII")] * 3 + [("k", "PCI"), ("j", "PHI")], "key string, tag string")
    assert {r["key"]: r["tags"] for r in rollup.tag_list(rows, ["key"]).collect()} == {"k": "PCI,PII,PII,PII", "j": "PHI"}


def test_options(spark):
    df = spark.createDataFrame([("1", '{"email":"x","note":"Amara"}'), ("2", '{"who":"Amara"}')], "msg_id string, value string")
    kept = classify(df, ["msg_id"], 3, exclude_names=("email",)).collect()
    assert {(r["msg_id"], r["field_path"]) for r in kept} == {("1", "note"), ("2", "who")}
    only = classify(df, ["msg_id"], 3, layer3_free_text_only=True).where("layer = 3").collect()
    assert [(r["msg_id"], r["field_path"], r["is_free_text"]) for r in only] == [("1", "note", True)]


def test_model_hook(texts):
    def load():
        def predict(values):
            labels = [("person", 0.91234567), ("person", 0.1), ("disease", 0.8), ("unheard of", 0.9)]
            return [[{"label": la, "start": 0, "end": 5, "score": s} for la, s in labels] if "Alice" in v else [] for v in values]

        return predict

    df = texts(["Alice was here", "  ", "nobody", None])
    found = detect(df, 3, recognizers=[predictor(load)]).select("id", F.explode("detections").alias("d")).select("id", "d.*").collect()
    assert sorted((r["id"], r["entity_type"], r["tag"], r["score"], r["text_snippet"], r["layer"], r["source"]) for r in found) == [
        (0, "MEDICAL_CONDITION", "PHI", 0.8, "Alice", 3, "ai_model"), (0, "PERSON", "PII", 0.9123, "Alice", 3, "ai_model"),
    ]
    one = detect(df, 3, recognizers=[predictor(load, entities=["PERSON"])]).select(F.explode("detections").alias("d")).select("d.*")
    assert [r["entity_type"] for r in one.collect()] == ["PERSON"]
    assert filter_entities(one, ["PERSON"], 0.95).count() == 0


def test_a_missing_model_is_reported_not_fatal():
    def broken():
        raise OSError("no model")

    ready, missing = available({"a": broken, "b": lambda: lambda texts: [[] for _ in texts]})
    assert len(ready) == 1 and missing == ["a"]


def test_phrases_by_join_and_by_regex_agree(spark, texts):
    phrases = [("Sleep Apnea", "disease"), ("Sleep", "disease"), ("Apnea Clinic", "disease"), ("New-Ghent", "home address"), ("Hanna", "person"), ("x", "not a label")]
    df = texts(["é Hanna: Sleep Apnea Clinic", "sleep", "Hanna Hannah", "", "in New-Ghent or New Ghent", "Sleep  Apnea", "aSleep Sleep"])
    table = spark.createDataFrame([(p, la, 0.85) for p, la in phrases], "phrase string, label string, score double")
    columns = ["id", "field_path", "entity_type", "tag", "score", "start", "end", "text_snippet", "layer", "source"]
    joined = gazetteer(df, table, ["id"], most_bytes=0).select(*columns).collect()
    assert sorted(map(tuple, gazetteer(df, table, ["id"]).select(*columns).collect())) == sorted(map(tuple, joined))
    inside = explode_detections(detect(df, 3, phrases=gazetteer_patterns(phrases))).where("layer = 3").select(*columns).collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, inside)) and len(joined) == 6


def test_phrases_with_marks_at_their_edges(spark, texts):
    phrases = [("C++", "disease", 0.7), ("C", "disease", 0.6), (".NET", "disease", 0.8), ("Müller", "person", 0.9), ("Müller & Söhne", "person", 0.9), ("++", "disease", 0.5), ("a", "no label", 0.5)]
    table = spark.createDataFrame(phrases, "phrase string, label string, score double")
    df = texts(["in C++ and C, not C++x", "use .NET or NET", "by Müller & Söhne, Müller, Müllers", None, "C"])
    found = [gazetteer(df, table, ["id"], most_bytes=m) for m in (0, 1 << 20)]
    rows = [sorted((r["id"], r["rank"], r["text_snippet"], r["start"], r["end"], r["score"]) for r in f.collect()) for f in found]
    assert rows[0] == rows[1] == [
        (0, 0, "C++", 3, 6, 0.7), (0, 1, "C", 11, 12, 0.6), (0, 2, "C++", 18, 21, 0.7), (1, 0, ".NET", 4, 8, 0.8),
        (2, 0, "Müller & Söhne", 3, 17, 0.9), (2, 1, "Müller", 19, 25, 0.9), (4, 0, "C", 0, 1, 0.6),
    ]
    assert sorted(r["phrase"] for r in rejected_phrases(table).collect()) == ["++", "a"]


def test_a_filter_loses_no_key_and_reference_hits_are_exact(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"))
    test = maybe_in(spark, bloom_bits(keys, "key"))
    asked = spark.range(9000).select("id", F.get(test(F.array(F.xxhash64("id"))), F.lit(0)).alias("in"))
    passed = {r["id"] for r in asked.where("in").collect()}
    assert set(range(3000)) <= passed and len(passed) < 3300
    flat = spark.createDataFrame([(1, "a", " Alpha "), (1, "b", None), (2, "a", "beta"), (3, "a", "")], "id int, field_path string, value string")
    known = spark.createDataFrame([("x", "alpha"), ("y", "ALPHA"), ("y", ""), ("z", None)], "set_name string, v string")
    for most in (64, 1 << 20):
        hits = reference_hits(flat, known.select("set_name", value_digest(F.col("v")).alias("digest")), ["id"], most)
        assert sorted(map(tuple, hits.collect())) == [(1, "a", "x"), (1, "a", "y"), (3, "a", "y")]
    assert reference_hits(flat, known.limit(0).select("set_name", F.col("v").alias("digest")), ["id"]).collect() == []


def test_a_phrase_table_in_classify(spark):
    df = spark.createDataFrame([("1", '{"note":"Hanna has a Sleep Apnea","email":"x"}'), ("2", '{"n":1}')], "msg_id string, value string")
    table = spark.createDataFrame([("Sleep Apnea", "disease", 0.9)], "phrase string, label string, score double")
    got = classify(df, ["msg_id"], 3, phrase_table=table, phrases=[]).collect()
    assert sorted((r["msg_id"], r["field_path"], r["tag"], r["layer"], r["text_snippet"]) for r in got) == [
        ("1", "email", "PII", 1, "x"), ("1", "note", "PHI", 3, "Sleep Apnea"),
    ]
    assert {r["layer"] for r in classify(df, ["msg_id"], 2, phrase_table=table).collect()} == {1}


def test_classes_in_the_row_agree_with_detection(spark):
    import json

    from fieldscan.operators import routing

    deep: object = {"ssn": "1", "notes": [["call (212) 555-0188", {"email": "a@b.example"}], None, {}, []]}
    for i in range(12):
        deep = {f"l{i}": [deep, i]} if i % 2 else {f"l{i}": deep, "password": "x"}
    values = [json.dumps(deep), '{"email":"a","email":"b"}', "[1]", "no", None, "{}", '{"a":{"ssn":{"x":"2"}},"iban":["NL91ABNA0417164300"]}', '{"note":"Hanna had Asthma","n":1}']
    messages = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "msg_id string, value string")
    for layers, options in ((3, {}), (2, {"exclude_names": ("ssn",)}), (3, {"layer3_free_text_only": True})):
        rows = routing.with_classes(messages, layers, **options)
        got = sorted(
            (r["msg_id"], path, d["entity_type"], d["score"], d["start"], d["end"], d["text_snippet"], d["layer"], d["is_free_text"])
            for r in rows.collect() for path, ds in r["detected_entities"].items() for d in ds
        )
        found = classify(messages, ["msg_id"], layers, **options).collect()
        columns = ["msg_id", "field_path", "entity_type", "score", "start", "end", "text_snippet", "layer", "is_free_text"]
        assert got == sorted(tuple(r[c] for c in columns) for r in found) and len(got) > 10
        assert {r["msg_id"]: r["tags"] for r in rows.collect() if r["tags"]} == {i: sorted({r["tag"] for r in found if r["msg_id"] == i}) for i in {r["msg_id"] for r in found}}
