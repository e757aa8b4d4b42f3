import json

import pytest

from fieldscan.operators.flatten import flatten_columns, flatten_variant, schema_leaves
from fieldscan.plans.classify import classify, classify_schema
from fieldscan.sources.messages import decode, drop_tombstones, record_json, schema_id, split_malformed, wire_body

RECORD = {
    "a": {"b": "x", "n": None, "blank": " "}, "list": [{"sku": 1}, {"sku": 2.5}, "raw"], "t": True, "e": {}, "l": [], "s": "{}",
    "odd.key": "v", "deep": [[["y"]]],
}
LEAVES = {
    "a.b": "x", "a.blank": " ", "list[0].sku": "1", "list[1].sku": "2.5", "list[2]": "raw", "t": "true", "s": "{}", "odd.key": "v",
    "deep[0][0][0]": "y",
}


def flat(spark, values, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value string")
    return {(r["id"], r["field_path"]): r["value"] for r in flatten_variant(decode(df), ["id"], **options).collect()}


def test_nested_record(spark):
    assert flat(spark, [json.dumps(RECORD)]) == {(0, k): v for k, v in LEAVES.items()}


def test_nulls_kept_for_reports(spark):
    assert flat(spark, [json.dumps(RECORD)], keep_nulls=True) == {(0, k): v for k, v in {**LEAVES, "a.n": ""}.items()}


def test_any_depth_gives_the_same_leaves(spark):
    deep = json.dumps({"a": [{"b": {"c": RECORD}}], "z": 1.50, "big": 12345678901234567890123, "e": 1e3, "q": 'a "b" \\ \n ü'})
    expected = flat(spark, [deep], levels=12)
    assert expected[(0, "a[0].b.c.deep[0][0][0]")] == "y"
    for levels in (0, 1, 2, 6):
        assert flat(spark, [deep], levels=levels) == expected
        assert flat(spark, [deep, None, "[]"], levels=levels, keep_nulls=True) == flat(spark, [deep, None, "[]"], levels=12, keep_nulls=True)


def test_a_secret_far_down_is_found(spark):
    value: object = {"ssn": "1", "password": "x"}
    for i in range(200):
        value = {f"l{i}": value} if i % 3 else [value]
    got = classify(spark.createDataFrame([("1", json.dumps(value))], "msg_id string, value string"), ["msg_id"], 1).collect()
    assert {r["tag"] for r in got} == {"GOVERNMENT_ID", "CREDENTIALS"}


def test_a_container_of_very_many_leaves_is_taken_apart_natively(spark):
    value = {"n": [{"k": i, 'odd "name" \\ {}': [None, [], "a, b: [c]"]} for i in range(20_000)]}
    rows = flat(spark, [json.dumps(value)], levels=0)
    assert rows == {(0, f"n[{i}].k"): str(i) for i in range(20_000)} | {(0, f'n[{i}].odd "name" \\ {{}}[2]'): "a, b: [c]" for i in range(20_000)}
    plan = flatten_variant(decode(spark.createDataFrame([(1, "{}")], "id int, value string")), ["id"])._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_unreadable_messages_are_set_aside(spark):
    values = ['{"a":1}', "not json", "", None, "[1]", '{"a":1,"a":2}', "  ", '{"cut":']
    assert flat(spark, values) == {(0, "a"): "1", (5, "a"): "2"}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, value string")
    good, bad = split_malformed(decode(drop_tombstones(df)))
    assert sorted(r["id"] for r in good.collect()) == [0, 5] and sorted(r["id"] for r in bad.collect()) == [1, 4, 7]


def test_typed_flatten_agrees_with_json(spark):
    df = spark.sql(
        "SELECT 1 AS id, named_struct('x', 'v', 'n', cast(null AS string)) AS a, array(named_struct('k', 1), named_struct('k', 2)) AS l,"
        " map('m1', 'q') AS m, cast(array() AS array<string>) AS none, true AS t, cast(null AS array<int>) AS nul"
    )
    typed = {r["field_path"]: r["value"] for r in flatten_columns(df, ["id"]).collect()}
    as_json = df.select("id", record_json(["a", "l", "m", "none", "t", "nul"]).alias("value"))
    assert typed == {r["field_path"]: r["value"] for r in flatten_variant(decode(as_json), ["id"]).collect()}
    assert typed == {"a.x": "v", "l[0].k": "1", "l[1].k": "2", "m.m1": "q", "t": "true"}
    assert schema_leaves(df.schema) == ["id", "a", "a.x", "a.n", "l", "l.k", "m", "none", "t", "nul"]


def test_schema_alone_is_classified(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('email', 'v') AS customer, array(named_struct('ssn', 1)) AS people")
    got = {(r["name"], r["tag"]) for r in classify_schema(spark, df.schema).collect()}
    assert got == {("customer.email", "PII"), ("people.ssn", "GOVERNMENT_ID")}


@pytest.mark.parametrize(
    "raw, expected",
    [
        (b"\x00\x00\x00\x00\x2a{}", 42), (b"\x00" + (100001).to_bytes(4, "big") + b"x", 100001), (b"\x00\x00\x00\x00\x00", 0),
        (b'{"a":1}', None), (b"\x01\x00\x00\x00\x2a{}", None), (b"\x00\x01", None), (b"", None),
    ],
)
def test_wire_header(spark, raw, expected):
    df = spark.createDataFrame([(bytearray(raw),)], "value binary")
    row = df.select(schema_id(df.value).alias("id"), wire_body(df.value).alias("body")).first()
    assert row["id"] == expected
    assert bytes(row["body"]) == (raw[5:] if expected is not None else raw)


def test_wire_values_without_avro_fall_back_to_json(spark):
    df = spark.createDataFrame([(1, bytearray(b'{"email":"a@b.c"}')), (2, bytearray(b"\x00\x00\x00\x00\x2a\x06abc"))], "id int, value binary")
    got = {r["id"]: (r["schema_id"], r["payload"] is not None) for r in decode(df).collect()}
    assert got == {1: (None, True), 2: (42, False)}
