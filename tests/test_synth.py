import re

import pytest
from pyspark.sql import functions as F

from fieldscan.operators import registry
from fieldscan.sources import synth

SHAPE = {
    "ssn": r"\d{3}-\d{2}-\d{4}", "phone_number": r"\(\d{3}\) \d{3}-\d{4}", "iban": r"NL\d{2}[A-Z]{4}\d{10}", "api_key": r"pk_live_[a-z0-9]{24}",
    "aws_access_key_id": r"AKIA[A-Z0-9]{16}", "session_token": r"eyJ\w{17}\.\w{31}\.\w{43}", "dna_sequence": r"[ACGT]{60}",
    "fingerprint_hash": r"[0-9a-f]{48}", "gps_coordinates": r"-?\d+\.\d{5} -?\d+\.\d{5}", "swift_code": r"[A-Z]{6}[A-Z0-9]{2}",
    "email": r"[a-z]+_\d+@[a-z.]+", "crypto_wallet": r"0x[0-9a-f]{40}", "date_of_birth": r"(19|20)\d\d-\d\d-\d\d", "credit_card_number": r"5\d{15}",
}


def test_records_are_realistic_half_empty_and_repeatable(spark):
    ids = spark.range(400).withColumnRenamed("id", "row")
    made = synth.synthetic_records(ids, "row", seed=3)
    rows = {r["row"]: r for r in made.collect()}
    for name, shape in SHAPE.items():
        values = [r[name] for r in rows.values() if r[name] is not None]
        assert 140 < len(values) < 260 and len(set(values)) > 5, name
        assert all(re.fullmatch(shape, v) for v in values), (name, values[:2])
    again = synth.synthetic_records(ids.repartition(7), "row", seed=3)
    assert {r["row"]: r for r in again.collect()} == rows
    other = synth.synthetic_records(ids, "row", seed=4).where("row = 1").first()
    assert other != rows[1]


@pytest.mark.parametrize("n", [5, 8, 20, 46])
def test_selection_is_balanced(spark, n):
    picked = synth.select_fields(spark, n, seed=n).collect()
    assert len({r["name"] for r in picked}) == n
    first = synth.PRIORITY[: min(n, 8)]
    assert [r["category"] for r in picked][: len(first)] == first
    assert picked == synth.select_fields(spark, n, seed=n).collect()


def test_selection_bounds_and_schema(spark):
    for n in (4, 47):
        with pytest.raises(ValueError):
            synth.select_fields(spark, n)
    a, b = ({r["name"] for r in synth.select_fields(spark, 10, seed=s).collect()} for s in (1, 2))
    assert a != b
    fields = [(r["name"], r["avro_type"]) for r in synth.select_fields(spark, 12).collect()]
    import json

    text = json.dumps(synth.avro_schema(fields))
    df = spark.createDataFrame([("s", 1, 1, None, text)], "subject string, version int, id int, schema_type string, schema string")
    assert {r["field_path"] for r in registry.schema_fields(df).collect()} == {n for n, _ in fields}
    assert df.select(registry.record_qualifier(F.col("schema"))).first()[0] == "demo.DemoRecord"
