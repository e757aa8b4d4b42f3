import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fieldscan.operators import registry, review

INCOMING = (
    "topic string, subject string, schema_id int, field_path string, proposed_tag string, entity_type string, "
    "confidence double, layer int, source string, is_free_text boolean"
)
T0 = "2024-01-01 00:00:00"
AVRO = json.dumps({"type": "record", "name": "R", "namespace": "n", "fields": [
    {"name": "email", "type": "string"}, {"name": "items", "type": {"type": "array", "items": {"type": "record", "name": "I", "fields": [{"name": "sku", "type": "string"}]}}}]})


def rec(path, tag="PII", confidence=0.9, topic="t", schema_id=None, entity="E", free=False):
    return (topic, f"{topic}-value", schema_id, path, tag, entity, confidence, 2, "regex", free)


@pytest.fixture
def store(spark):
    def make(*rows, status=None):
        recs = review.upsert(None, spark.createDataFrame(list(rows), INCOMING), T0)
        for path, state in (status or {}).items():
            recs = recs.withColumn("status", F.when(F.col("field_path") == path, state).otherwise(F.col("status")))
        return recs

    return make


def by_path(recs):
    return {r["field_path"]: r for r in recs.collect()}


def test_upsert(spark, store):
    old = store(rec("up", confidence=0.6), rec("down"), rec("staged", confidence=0.5), rec("gone", confidence=0.5), rec("stay"),
                status={"staged": "STAGED", "gone": "REJECTED"})
    new = [rec("up", confidence=0.97, entity="N", schema_id=4, free=True), rec("up", confidence=0.7), rec("down", confidence=0.5),
           rec("staged", confidence=0.99), rec("gone", confidence=0.99), rec("new", confidence=0.7)]
    got = by_path(review.upsert(old, spark.createDataFrame(new, INCOMING), "2024-02-02 00:00:00"))
    assert {p: (r["confidence"], r["confidence_tier"], r["status"]) for p, r in got.items()} == {
        "up": (0.97, "HIGH", "PENDING"), "down": (0.9, "HIGH", "PENDING"), "staged": (0.5, "LOW", "STAGED"), "gone": (0.5, "LOW", "REJECTED"),
        "stay": (0.9, "HIGH", "PENDING"), "new": (0.7, "MEDIUM", "PENDING"),
    }
    up = got["up"]
    assert (up["entity_type"], up["schema_id"], up["is_free_text"], up["created_at"]) == ("N", 4, False, dt.datetime(2024, 1, 1))
    assert up["id"] == by_path(old)["up"]["id"] and got["new"]["created_at"] == dt.datetime(2024, 2, 2)


def test_decisions_follow_the_states(spark, store):
    recs = store(rec("a"), rec("b"), rec("c"), rec("done"), status={"done": "APPROVED"})
    ids = {p: r["id"] for p, r in by_path(recs).items()}
    script = [
        ("a", "approve", 1, "ok"), ("a", "approve", 2, "conflict"), ("a", "unstage", 3, "ok"), ("a", "unstage", 4, "conflict"),
        ("a", "approve", 5000, "ok"), ("b", "unstage", 1, "conflict"), ("b", "reject", 2, "ok"), ("b", "approve", 9000, "conflict"),
        ("b", "reject", 9001, "conflict"), ("c", "approve", 1, "ok"), ("c", "reject", 2, "ok"), ("done", "approve", 1, "conflict"),
        ("done", "reject", 2, "conflict"), ("ghost", "approve", 1, "not_found"),
    ]
    base = dt.datetime(2024, 3, 1)
    rows = [(ids.get(p, "ghost"), a, f"by{s}", base + dt.timedelta(seconds=s)) for p, a, s, _ in script]
    after, outcomes = review.apply_decisions(recs, spark.createDataFrame(rows, "rec_id string, action string, reviewer string, at timestamp"))
    got = {(r["rec_id"], r["at"]): r["outcome"] for r in outcomes.collect()}
    assert got == {(r[0], r[3]): want for r, (_, _, _, want) in zip(rows, script)}
    assert {p: (r["status"], r["reviewed_by"]) for p, r in by_path(after).items()} == {
        "a": ("STAGED", "by5000"), "b": ("REJECTED", "by2"), "c": ("REJECTED", "by2"), "done": ("APPROVED", None),
    }


def test_decisions_against_a_plain_replay(spark, store):
    import random

    rng = random.Random(5)
    recs = store(*[rec(f"f{i}") for i in range(6)], status={"f1": "STAGED", "f2": "REJECTED"})
    states = {r["id"]: r["status"] for r in recs.collect()}
    base = dt.datetime(2024, 3, 1)
    rows = [(rng.choice(list(states)), rng.choice(["approve"] * 5 + ["unstage"] * 5 + ["reject"]), "r", base + dt.timedelta(minutes=7 * i)) for i in range(300)]
    moves = {"approve": (["PENDING"], "STAGED"), "unstage": (["STAGED"], "PENDING"), "reject": (["PENDING", "STAGED"], "REJECTED")}
    want = []
    for rid, action, _, at in rows:
        ok = states[rid] in moves[action][0]
        want.append((rid, at, "ok" if ok else "conflict"))
        states[rid] = moves[action][1] if ok else states[rid]
    after, outcomes = review.apply_decisions(recs, spark.createDataFrame(rows, "rec_id string, action string, reviewer string, at timestamp"))
    assert sorted((r["rec_id"], r["at"], r["outcome"]) for r in outcomes.collect()) == sorted(want)
    assert {r["id"]: r["status"] for r in after.collect()} == states


@pytest.fixture
def schemas(spark):
    rows = [("t-value", 1, 10, None, json.dumps({"type": "record", "name": "R", "fields": [{"name": "old", "type": "int"}]})), ("t-value", 2, 11, None, AVRO),
            ("p-value", 1, 20, "PROTOBUF", "message X {}")]
    return spark.createDataFrame(rows, "subject string, version int, id int, schema_type string, schema string")


def test_validate_and_submit(store, schemas):
    staged = ["email", "items[0].sku", "old", "ghost.field", "p", "q", "pinned"]
    recs = store(
        rec("email"), rec("email", tag="PHI"), rec("items[0].sku"), rec("old", schema_id=10), rec("ghost.field"), rec("p", topic="p"), rec("q", topic="none"),
        rec("pinned", schema_id=99), rec("later"), status={p: "STAGED" for p in staged},
    )
    fields = registry.schema_fields(schemas)
    checks = {(r["field_path"], r["proposed_tag"]): r["reason"] for r in review.validate_staged(recs, schemas, fields).collect()}
    assert checks == {
        ("email", "PII"): None, ("email", "PHI"): None, ("items[0].sku", "PII"): None, ("old", "PII"): None, ("ghost.field", "PII"): "field not in current SR schema",
        ("p", "PII"): "could not fetch/parse SR schema", ("q", "PII"): "could not resolve schema version in SR", ("pinned", "PII"): "could not resolve schema version in SR",
    }
    strict = {r["field_path"]: r["valid"] for r in review.validate_staged(recs, schemas, fields, strict_paths=True).collect()}
    assert strict["items[0].sku"] is False and strict["email"] is True
    after, catalog = review.submit_staged(recs, schemas, fields, "c1", "2024-05-05 00:00:00", "me")
    got = by_path(after)
    assert {p: got[p]["status"] for p in got} == {
        "email": "APPROVED", "items[0].sku": "APPROVED", "old": "APPROVED", "ghost.field": "REJECTED", "p": "REJECTED", "q": "REJECTED", "pinned": "REJECTED", "later": "PENDING",
    }
    assert got["ghost.field"]["reviewed_by"] == "auto: field not in current SR schema" and got["email"]["reviewed_by"] == "me"
    assert sorted(tuple(r) for r in catalog.collect()) == [
        ("sr_field", "c1:.:10:R.old", "PII"), ("sr_field", "c1:.:11:n.R.email", "PHI"), ("sr_field", "c1:.:11:n.R.email", "PII"), ("sr_field", "c1:.:11:n.R.items.sku", "PII"),
    ]
    failed, _ = review.submit_staged(recs, schemas, fields, "c1", T0, "me", pushed=False)
    states = {p: r["status"] for p, r in by_path(failed).items()}
    assert states["email"] == "STAGED" and states["ghost.field"] == "REJECTED"


def test_bulk_list_summary_sources_delete(store, schemas):
    recs = store(rec("email"), rec("card", tag="PCI", confidence=0.7), rec("low", confidence=0.3), rec("x", topic="u"), status={"x": "APPROVED"})
    staged = by_path(review.bulk_stage(recs, T0, 0.6, "t"))
    assert {p: r["status"] for p, r in staged.items()} == {"email": "STAGED", "card": "STAGED", "low": "PENDING", "x": "APPROVED"}
    assert by_path(review.bulk_stage(recs, T0, tag="PCI"))["card"]["status"] == "PENDING"
    after, _ = review.bulk_approve(recs, schemas, registry.schema_fields(schemas), "c1", T0, min_confidence=0.6, topic="t")
    assert {p: r["status"] for p, r in by_path(after).items()} == {"email": "APPROVED", "card": "REJECTED", "low": "PENDING", "x": "APPROVED"}
    assert [tuple(r) for r in review.review_summary(after).collect()] == [("t", 1, 0, 1, 1), ("u", 0, 0, 1, 0)]
    assert [r["field_path"] for r in review.list_recommendations(recs, status="PENDING").collect()] == ["email", "card", "low"]
    assert [r["field_path"] for r in review.list_recommendations(recs, topic="t", tag="PII", tier="LOW").collect()] == ["low"]
    assert [tuple(r) for r in review.topic_sources(recs, schemas).collect()] == [("t", "t-value", 2, 11, 3), ("u", "u-value", None, None, 1)]
    rid = by_path(recs)["x"]["id"]
    assert review.get_recommendation(recs, rid).count() == 1
    left, gone = review.delete_topic(recs, "t")
    assert left.count() == 1 and gone.first()["deleted"] == 3
    with pytest.raises(ValueError):
        review.delete_topic(recs, "")


def test_alike_detections_are_made_one_by_hash(spark, capsys):
    rows = [rec("a"), rec("a"), rec("a", confidence=0.95), rec("a", confidence=0.95, schema_id=3), rec(None), rec(None)]
    best = review.best_incoming(spark.createDataFrame(rows, INCOMING))
    assert sorted((r["field_path"] or "", r["confidence"], r["schema_id"]) for r in best.collect()) == [("", 0.9, None), ("a", 0.95, None)]
    best.explain()
    plan = capsys.readouterr().out
    # The lowest step over the batch hashes: nothing is sorted by key before it.
    assert plan.rindex("HashAggregate") > plan.rindex("Sort [")
