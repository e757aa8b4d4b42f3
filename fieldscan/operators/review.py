"""The life of a recommendation: upsert, decide, submit, report.

A store is a snapshot DataFrame; every operation takes one and returns the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscan.functions.taxonomy import confidence_tier
from fieldscan.functions.text import subject_of
from fieldscan.operators.registry import catalog_rows, latest_schema, validated

COLUMNS = [
    "id", "topic", "subject", "schema_id", "field_path", "proposed_tag", "entity_type", "confidence",
    "confidence_tier", "layer", "source", "is_free_text", "status", "created_at", "reviewed_at", "reviewed_by",
]
SCHEMA = (
    "id string, topic string, subject string, schema_id int, field_path string, proposed_tag string, "
    "entity_type string, confidence double, confidence_tier string, layer int, source string, "
    "is_free_text boolean, status string, created_at timestamp, reviewed_at timestamp, reviewed_by string"
)
KEY = ["topic", "field_path", "proposed_tag"]
# Columns a better detection replaces on a pending row.
REPLACED = ["confidence", "confidence_tier", "entity_type", "schema_id", "layer", "source"]
BULK_CONFIDENCE = 0.85


def _moment(now) -> Column:
    """A time given as text, datetime or column."""
    return F.lit(now).cast("timestamp")


def rec_id(topic: str = "topic", path: str = "field_path", tag: str = "proposed_tag") -> Column:
    return F.sha2(F.concat_ws("\x1f", topic, path, tag), 256)


def from_detections(best: DataFrame, topic: str = "topic") -> DataFrame:
    """Best detections per field and tag as incoming recommendations."""
    return best.select(
        F.col(topic).alias("topic"),
        subject_of(F.col(topic)).alias("subject"),
        (F.col("schema_id") if "schema_id" in best.columns else F.lit(None)).cast("int").alias("schema_id"),
        "field_path",
        F.col("tag").alias("proposed_tag"),
        "entity_type",
        F.col("score").alias("confidence"),
        "layer",
        "source",
        "is_free_text",
    )


def from_results(results: DataFrame) -> DataFrame:
    """Scan results, stamped with a schema id, as incoming recommendations: the tag
    stands in for the entity type, and nothing says it is free text."""
    return results.select(
        F.col("source_topic").alias("topic"),
        "subject",
        "schema_id",
        "field_path",
        F.col("tag").alias("proposed_tag"),
        F.col("tag").alias("entity_type"),
        "confidence",
        "layer",
        "source",
        F.lit(False).alias("is_free_text"),
    )


def best_incoming(incoming: DataFrame) -> DataFrame:
    """The best row per key of a batch of detections; of a batch that holds a key once, the batch.

    Most detections of a field are alike: they are made distinct by hash first, since rows
    that hold text are sorted by key to find the least.
    """
    values = [c for c in incoming.columns if c not in KEY]
    order = F.struct(
        (-F.col("confidence")).alias("down"), "layer", "source", "entity_type", "subject",
        F.coalesce("schema_id", F.lit(-1)).alias("sid"), "is_free_text",
    )
    return incoming.distinct().groupBy(*KEY).agg(F.min_by(F.struct(*values), order).alias("b")).select(*KEY, "b.*")


def upsert(recs: DataFrame | None, incoming: DataFrame, now) -> DataFrame:
    """Next snapshot after a batch of detections.

    The batch shrinks to its best row per key first (partial on the map side), so
    both sides of the join hold a key once. A pending row takes the better
    confidence; a row in any other state stays as it is; a new key starts pending.
    """
    best = best_incoming(incoming)
    new = best.select(
        rec_id().alias("id"), *best.columns,
        confidence_tier(F.col("confidence")).alias("confidence_tier"),
        F.lit("PENDING").alias("status"), _moment(now).alias("created_at"),
        F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit(None).cast("string").alias("reviewed_by"),
    ).select(*COLUMNS)
    if recs is None:
        return new
    o, n = recs.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in KEY]
    isnew = F.col("o.id").isNull()
    better = (F.col("o.status") == "PENDING") & (F.col("n.confidence") > F.col("o.confidence"))
    return o.join(n, on, "full").select(
        *[
            F.when(isnew | better if c in REPLACED else isnew, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
            for c in COLUMNS
        ]
    )


def apply_decisions(recs: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, outcome per decision) for ``decisions(rec_id, action, reviewer, at)``.

    Actions are approve (PENDING→STAGED), unstage (STAGED→PENDING) and reject
    (PENDING or STAGED→REJECTED), taken in time order. Until its first reject a
    row is STAGED after any approve and PENDING after any unstage, so the state a
    decision meets follows from the action just before it. That action is found
    inside the hour, and between hours over one row per hour, which keeps the
    sorts short for a row that draws very many decisions.
    """
    order = F.struct("at", "action", F.coalesce("reviewer", F.lit("")).alias("who"))
    d = decisions.withColumn("place", order).withColumn("hour", F.date_trunc("hour", "at"))
    hours = d.groupBy("rec_id", "hour").agg(F.max_by("action", "place").alias("last_action"))
    per_rec, per_hour = Window.partitionBy("rec_id"), Window.partitionBy("rec_id", "hour")
    hours = hours.select("rec_id", "hour", F.lag("last_action").over(per_rec.orderBy("hour")).alias("hour_before"))
    first_reject = d.where(F.col("action") == "reject").groupBy("rec_id").agg(F.min("place").alias("rejected_at"))
    states = recs.select(F.col("id").alias("rec_id"), "status")
    seen = (
        d.withColumn("before", F.lag("action").over(per_hour.orderBy("place")))
        .join(hours, ["rec_id", "hour"], "left")
        .withColumn("before", F.coalesce("before", "hour_before"))
        .join(first_reject, "rec_id", "left")
        .join(states, "rec_id", "left")
    )
    live = F.col("status").isin("PENDING", "STAGED")
    state = (
        F.when(~live, F.col("status"))
        .when(F.col("rejected_at") < F.col("place"), "REJECTED")
        .when(F.col("before") == "approve", "STAGED")
        .when(F.col("before") == "unstage", "PENDING")
        .otherwise(F.col("status"))
    )
    fits = (
        ((F.col("action") == "approve") & (state == "PENDING"))
        | ((F.col("action") == "unstage") & (state == "STAGED"))
        | ((F.col("action") == "reject") & state.isin("PENDING", "STAGED"))
    )
    outcome = F.when(F.col("status").isNull(), "not_found").when(fits, "ok").otherwise("conflict")
    judged = seen.withColumn("outcome", outcome)
    becomes = F.element_at(
        F.create_map(F.lit("approve"), F.lit("STAGED"), F.lit("unstage"), F.lit("PENDING"), F.lit("reject"), F.lit("REJECTED")),
        F.col("last.action"),
    )
    last = (
        judged.where(F.col("outcome") == "ok")
        .groupBy(F.col("rec_id").alias("id"))
        .agg(F.max_by(F.struct("action", "reviewer", "at"), "place").alias("last"))
    )
    changed = F.col("last").isNotNull()
    after = recs.join(last, "id", "left").select(
        *[
            {
                "status": F.when(changed, becomes).otherwise(F.col("status")),
                "reviewed_at": F.when(changed, F.col("last.at")).otherwise(F.col("reviewed_at")),
                "reviewed_by": F.when(changed, F.col("last.reviewer")).otherwise(F.col("reviewed_by")),
            }.get(c, F.col(c)).alias(c)
            for c in COLUMNS
        ]
    )
    return after, judged.select("rec_id", "action", "reviewer", "at", "outcome")


def _bulk(min_confidence: float, topic: str | None, tag: str | None) -> Column:
    hit = (F.col("status") == "PENDING") & (F.col("confidence") >= min_confidence)
    if topic:
        hit &= F.col("topic") == topic
    if tag:
        hit &= F.col("proposed_tag") == tag
    return hit


def bulk_stage(
    recs: DataFrame, now, min_confidence: float = BULK_CONFIDENCE, topic: str | None = None, tag: str | None = None
) -> DataFrame:
    """Stage every pending row at or over a confidence, of one topic or tag if named."""
    hit = _bulk(min_confidence, topic, tag)
    return recs.withColumns(
        {
            "status": F.when(hit, "STAGED").otherwise(F.col("status")),
            "reviewed_at": F.when(hit, _moment(now)).otherwise(F.col("reviewed_at")),
        }
    )


def validate_staged(recs: DataFrame, schemas: DataFrame, fields: DataFrame, strict_paths: bool = False) -> DataFrame:
    """Staged rows with ``valid`` and ``reason``; nothing is changed."""
    checked = validated(recs.where(F.col("status") == "STAGED"), schemas, fields, strict_paths)
    return checked.select("id", "topic", "subject", "field_path", "proposed_tag", F.col("reason").isNull().alias("valid"), "reason")


def submit_staged(
    recs: DataFrame,
    schemas: DataFrame,
    fields: DataFrame,
    cluster: str,
    now,
    reviewer: str | None = None,
    pushed: bool = True,
    strict_paths: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, catalog rows) of sending all staged rows as one batch.

    A row whose field the schema does not list is rejected with the reason, and so
    is any staged row of the same subject and field. The rest are approved, unless
    the catalog write failed (``pushed=False``): then they stay staged.
    """
    checked = validated(recs.where(F.col("status") == "STAGED"), schemas, fields, strict_paths)
    dropped = (
        checked.where(F.col("reason").isNotNull())
        .groupBy("subject", "field_path")
        .agg(F.min_by("reason", F.struct("confidence", "proposed_tag")).alias("dropped_for"))
    )
    staged = F.col("status") == "STAGED"
    out = staged & F.col("dropped_for").isNotNull()
    passed = staged & F.col("dropped_for").isNull() & F.lit(pushed)
    after = recs.join(dropped, ["subject", "field_path"], "left").select(
        *[
            {
                "status": F.when(out, "REJECTED").when(passed, "APPROVED").otherwise(F.col("status")),
                "reviewed_at": F.when(out | passed, _moment(now)).otherwise(F.col("reviewed_at")),
                "reviewed_by": F.when(out, F.concat(F.lit("auto: "), "dropped_for"))
                .when(passed, F.lit(reviewer))
                .otherwise(F.col("reviewed_by")),
            }.get(c, F.col(c)).alias(c)
            for c in COLUMNS
        ]
    )
    return after, catalog_rows(checked, cluster)


def bulk_approve(recs, schemas, fields, cluster, now, min_confidence=BULK_CONFIDENCE, topic=None, tag=None, **options):
    """Stage by threshold, then submit everything staged."""
    return submit_staged(bulk_stage(recs, now, min_confidence, topic, tag), schemas, fields, cluster, now, **options)


def list_recommendations(recs: DataFrame, status=None, topic=None, tag=None, tier=None) -> DataFrame:
    """Rows that meet every given filter, best confidence first."""
    wanted = {"status": status, "topic": topic, "proposed_tag": tag, "confidence_tier": tier}
    for column, value in wanted.items():
        if value:
            recs = recs.where(F.col(column) == value)
    return recs.orderBy(F.desc("confidence"), "id")


def get_recommendation(recs: DataFrame, rec: str) -> DataFrame:
    return recs.where(F.col("id") == rec)


def review_summary(recs: DataFrame) -> DataFrame:
    """Pending, staged, approved and rejected rows per topic."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PENDING", "STAGED", "APPROVED", "REJECTED")]
    return recs.groupBy("topic").agg(*counts).orderBy("topic")


def topic_sources(recs: DataFrame, schemas: DataFrame) -> DataFrame:
    """Each topic with its subject, current schema (null if none) and row count."""
    current = latest_schema(schemas).select("subject", "version", F.col("id").alias("schema_id"))
    topics = recs.groupBy("topic").agg(F.count(F.lit(1)).alias("count")).withColumn("subject", subject_of(F.col("topic")))
    return topics.join(current, "subject", "left").select("topic", "subject", "version", "schema_id", "count").orderBy("topic")


def delete_topic(recs: DataFrame, topic: str) -> tuple[DataFrame, DataFrame]:
    """(snapshot without the topic, its row count); a blank topic is refused."""
    if not topic:
        raise ValueError("topic required")
    gone = F.col("topic") == topic
    return recs.where(~gone), recs.where(gone).agg(F.count(F.lit(1)).alias("deleted")).withColumn("topic", F.lit(topic))
