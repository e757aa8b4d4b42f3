import pytest
from pyspark.sql import functions as F

from fieldscan.operators import review
from fieldscan.operators.store import RESULT, Recommendations, Results
from fieldscan.sources import manifest

INCOMING = "topic string, subject string, schema_id int, field_path string, proposed_tag string, entity_type string, confidence double, layer int, source string, is_free_text boolean"


def batch(spark, rows):
    return spark.createDataFrame([(t, f"{t}-value", None, p, g, g, c, 1, "field_name", False) for t, p, g, c in rows], INCOMING)


def state(store):
    return {(r["topic"], r["field_path"], r["proposed_tag"]): (r["status"], r["confidence"]) for r in store.snapshot().collect()}


def test_a_batch_rewrites_its_buckets_only_and_meets_every_state(spark, tmp_path):
    store = Recommendations(spark, str(tmp_path / "s"), 16)
    rows = [("t", f"f{i}", "PII", 0.6) for i in range(40)]
    assert store.upsert(batch(spark, rows), "2024-01-01") == 1
    ids = {r["field_path"]: r["id"] for r in store.snapshot().collect()}
    decided = [(ids["f0"], "approve"), (ids["f1"], "reject")]
    store.decide(spark.createDataFrame([(i, a, "me", 5) for i, a in decided], "rec_id string, action string, reviewer string, at int").withColumn("at", F.timestamp_seconds("at")))
    one = spark.createDataFrame([(ids["f2"],)], "id string")
    store.change(one, lambda old: old.withColumn("status", F.when(F.col("id") == ids["f2"], "APPROVED").otherwise(F.col("status"))))
    before = {e["bucket"]: e["path"] for e in manifest.entries(spark, store.root)[1]}
    again = [("t", f"f{i}", "PII", 0.9) for i in range(4)] + [("t", "new", "PCI", 0.7)]
    assert store.upsert(batch(spark, again), "2024-01-02") == 4
    after = {e["bucket"]: e["path"] for e in manifest.entries(spark, store.root)[1]}
    assert 0 < sum(before.get(b) != p for b, p in after.items()) <= 5
    got = state(store)
    assert [got["t", f"f{i}", "PII"] for i in range(5)] == [("STAGED", 0.6), ("REJECTED", 0.6), ("APPROVED", 0.6), ("PENDING", 0.9), ("PENDING", 0.6)]
    assert got["t", "new", "PCI"] == ("PENDING", 0.7) and len(got) == 41
    assert store.snapshot(1).count() == 40 and manifest.vacuum(spark, store.root, 1) > 0 and state(store) == got


def test_two_writers_from_one_version(spark, tmp_path):
    store = Recommendations(spark, str(tmp_path / "s"), 8)
    store.upsert(batch(spark, [("t", f"f{i}", "PII", 0.5) for i in range(20)]), "2024-01-01")
    store.upsert(batch(spark, [("t", f"f{i}", "PII", 0.6) for i in range(12)]), "2024-01-02", base=1)
    # The second one started from version 1, too: it meets the first one's rows and loses none.
    assert store.upsert(batch(spark, [("t", f"f{i}", "PII", 0.7) for i in range(8, 20)]), "2024-01-02", base=1) == 3
    got = state(store)
    assert [got["t", f"f{i}", "PII"][1] for i in range(20)] == [0.6] * 8 + [0.7] * 12
    with pytest.raises(manifest.Conflict):
        store.upsert(batch(spark, [("t", "f1", "PII", 0.9)]), "2024-01-03", base=1, tries=1)
    assert state(store) == got


def test_results_are_appended_merged_and_expired(spark, tmp_path):
    log = Results(spark, str(tmp_path / "r"))
    assert log.read().count() == 0
    for day in range(1, 11):
        for part in range(3):
            rows = [(f"f{part}", "PII", 0.5, 1, "regex", "x", t, "manual", f"2024-01-{day:02d} 0{part}:00:00") for t in ("a b/c", "d")]
            schema = RESULT.replace("scanned_at timestamp", "scanned_at string")
            log.append(spark.createDataFrame(rows, schema).withColumn("scanned_at", F.col("scanned_at").cast("timestamp")))
    assert log.parts() == 60 and log.read("a b/c").count() == 30
    log.expire("2024-01-10")
    assert log.read().agg(F.min(F.to_date("scanned_at")).cast("string")).first()[0] == "2024-01-04" and log.parts() == 42
    rows = lambda: sorted(map(tuple, log.read().collect()))
    before = rows()
    log.compact(2)
    assert log.parts() == 14 and rows() == before and log.read("d", "2024-01-09").count() == 6
    assert manifest.vacuum(spark, log.root, 1) > 20 and rows() == before
    assert log.compact(2) == 0


def test_a_batch_is_worked_out_once(spark, tmp_path):
    """Its keys are asked for before its rows."""
    from fieldscan.operators import review, store

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    kind = "topic string, subject string, schema_id int, field_path string, proposed_tag string, entity_type string, confidence double, layer int, source string, is_free_text boolean"
    rows = [("t", "t-value", 1, f"f{i % 5}", "PII", "EMAIL_ADDRESS", i / 20, 2, "regex", False) for i in range(20)]
    kept = store.Recommendations(spark, str(tmp_path / "store"), 4)
    kept.upsert(spark.createDataFrame(rows, kind).mapInPandas(counted, kind), "2024-01-01 00:00:00")
    assert seen.value == 20
    assert sorted((r["field_path"], r["confidence"]) for r in kept.snapshot().collect()) == [(f"f{i}", (15 + i) / 20) for i in range(5)]
    assert review.best_incoming(spark.createDataFrame(rows, kind)).count() == 5
