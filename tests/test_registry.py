import json

import pytest
from pyspark.sql import functions as F

from fieldscan.functions.text import qualified_name
from fieldscan.operators import registry


def record(name, *fields, **extra):
    return {"type": "record", "name": name, "fields": [{"name": n, "type": t} for n, t in fields], **extra}


SHAPES = {
    "flat": (record("Foo", ("ssn", "string"), ("email", "string"), ("age", "int")), "ssn email age"),
    "nested": (record("O", ("customer", record("C", ("email", "string"))), ("at", "long")), "customer customer.email at"),
    "deep": (record("A", ("b", record("B", ("c", record("C", ("d", "string")))))), "b b.c b.c.d"),
    "nullable": (record("U", ("address", ["null", record("Address", ("city", "string"))])), "address address.city"),
    "records": (record("K", ("items", {"type": "array", "items": record("I", ("sku", "string"))})), "items items.sku"),
    "plain list": (record("T", ("tags", {"type": "array", "items": "string"})), "tags"),
    "map": (record("M", ("attrs", {"type": "map", "values": record("At", ("v", "string"))})), "attrs attrs.v"),
    "leaves": (record("E", ("color", {"type": "enum", "name": "C", "symbols": ["R"]}), ("digest", {"type": "fixed", "name": "D", "size": 16})), "color digest"),
    "wrapped": (record("W", ("w", {"type": {"type": "array", "items": record("X", ("y", "int"))}})), "w w.y"),
}
BROKEN = [("bad json", "AVRO", "{ this is not json"), ("missing", "AVRO", None), ("json", "JSON", '{"properties":{"a":{}}}'), ("proto", "PROTOBUF", "message X {}")]


@pytest.fixture(scope="module")
def schemas(spark):
    rows = [(s, 1, i, None if i % 2 else "AVRO", json.dumps(schema)) for i, (s, (schema, _)) in enumerate(SHAPES.items())]
    rows += [(s, 1, 100 + i, kind, text) for i, (s, kind, text) in enumerate(BROKEN)]
    return spark.createDataFrame(rows, "subject string, version int, id int, schema_type string, schema string")


def test_field_paths(schemas):
    got = {}
    for r in registry.schema_fields(schemas).collect():
        got.setdefault(r["subject"], set()).add(r["field_path"])
    assert got == {s: set(paths.split()) for s, (_, paths) in SHAPES.items()}


def test_qualifier_and_top_level(spark):
    texts = [
        json.dumps(record("N", ("a", "int"), ("b", "int"), namespace="x.y")), json.dumps(record("N", ("a", "int"))), json.dumps({"type": "record"}),
        '"string"', "{", None,
    ]
    df = spark.createDataFrame([(str(i), 1, i, None, t) for i, t in enumerate(texts)], "subject string, version int, id int, schema_type string, schema string")
    assert [r[0] for r in df.select(registry.record_qualifier(F.col("schema"))).collect()] == ["x.y.N", "N", None, None, None, None]
    top = {r["subject"]: (r["names"], r["problem"]) for r in registry.top_level_fields(df).collect()}
    assert top["0"] == (["a", "b"], None) and top["1"] == (["a"], None)
    assert [top[k][1] for k in "2345"] == ["record has no fields", "not a record schema", "not a record schema", "schema missing"]


TAGGED = record("T", namespace="n")
TAGGED["fields"] = [
    {"name": "email", "type": "string", "vendor:tags": ["PII", "PII"]},
    {"name": "pay", "type": ["null", record("P", ("iban", "string"), ("note", "string"))]},
]
JSON_SCHEMA = {"properties": {"a": {"tags": ["PHI"], "properties": {"b": {"v:tags": ["PCI"]}}, "items": {"properties": {"c": {"tags": ["NPI"]}}}}}}


@pytest.fixture(scope="module")
def tagged(spark):
    rows = [("s-value", 1, 7, None, json.dumps(record("T", ("email", "string"), ("old", "int"), namespace="n"))), ("s-value", 2, 8, None, json.dumps(TAGGED)),
            ("j-value", 3, 9, "JSON", json.dumps(JSON_SCHEMA))]
    return spark.createDataFrame(rows, "subject string, version int, id int, schema_type string, schema string")


def test_tags_versions_and_diff(tagged):
    tags = sorted((r["subject"], r["version"], r["field_path"], r["tag"]) for r in registry.field_tags(tagged).collect())
    assert tags == [("j-value", 3, "a", "PHI"), ("j-value", 3, "a.b", "PCI"), ("j-value", 3, "a.c", "NPI"), ("s-value", 2, "email", "PII")]
    assert {r["subject"]: (r["version"], r["id"]) for r in registry.latest_schema(tagged).collect()} == {"s-value": (2, 8), "j-value": (3, 9)}
    diff = {(r["field_path"], r["change"]) for r in registry.schema_diff(registry.schema_fields(tagged), 1, 2).collect()}
    assert diff == {("old", "removed"), ("pay", "added"), ("pay.iban", "added"), ("pay.note", "added")}


def test_apply_tags(spark, tagged):
    approvals = spark.createDataFrame(
        [("s-value", "pay.iban", "PCI"), ("s-value", "email", "PII"), ("s-value", "ghost", "PII"), ("j-value", "a", "PHI")],
        "subject string, field_path string, tag string",
    )
    got = {(r["subject"], r["field_path"]): (r["version"], r["tags"]) for r in registry.apply_tags(tagged, approvals).collect()}
    assert got == {
        ("s-value", "email"): (3, ["PII"]), ("s-value", "pay"): (3, []), ("s-value", "pay.iban"): (3, ["PCI"]), ("s-value", "pay.note"): (3, []),
        ("j-value", "a"): (3, ["PHI"]), ("j-value", "a.b"): (3, ["PCI"]), ("j-value", "a.c"): (3, ["NPI"]),
    }
    table = registry.tag_columns(spark.createDataFrame([(1, 2)], "a int, b int"), {"a": ["PII"], "zz": ["PCI"]})
    table = registry.tag_columns(table, {"a": ["PHI", "PII"]})
    assert table.schema["a"].metadata == {"tags": ["PII", "PHI"]} and table.schema["b"].metadata == {}


def test_definitions_and_names(spark):
    existing = spark.createDataFrame([("PII",), ("other",)], "name string")
    assert registry.missing_tag_definitions(spark, existing).count() == 10
    df = spark.createDataFrame([(100004, "io.x.Demo", "a.b")], "i int, q string, p string")
    assert df.select(qualified_name(F.lit("cluster-9"), F.col("i"), F.col("q"), F.col("p"))).first()[0] == "cluster-9:.:100004:io.x.Demo.a.b"
