"""Triggers, the sampled scan they start, and its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan.plans.classify import classify_fields

# Scan every 60 minutes over the last 2, keep results 7 days.
SCAN_MINUTES, SAMPLE_MINUTES, RETENTION_DAYS = 60, 2, 7
TRIGGER = ["trigger_type", "source_topic", "triggered_at"]


def scheduled_triggers(messages: DataFrame, minutes: int = SCAN_MINUTES, with_event_time: bool = False) -> DataFrame:
    """One trigger per topic at the end of every window that saw a message."""
    ends = messages.groupBy("topic", F.window("event_time", f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)))
    return ends.select(
        F.lit("scheduled").alias("trigger_type"),
        F.col("topic").alias("source_topic"),
        F.col("w.end").alias("triggered_at"),
        *([F.window_time("w").alias("closes_at")] if with_event_time else []),
    )


def manual_trigger(spark: SparkSession, topic: str) -> DataFrame:
    return spark.range(1).select(
        F.lit("manual").alias("trigger_type"),
        F.lit(topic).alias("source_topic"),
        F.current_timestamp().alias("triggered_at"),
    )


def schema_change_triggers(history: DataFrame) -> DataFrame:
    """A trigger each time a subject's version rises over all checked before.

    ``history(subject, version, checked_at)``. The first check only sets the
    baseline. Checks collapse to the first sight of each version before any
    window, so the window runs over versions and not over checks.
    """
    seen = history.groupBy("subject", "version").agg(F.min("checked_at").alias("first_seen"))
    # Versions first seen in one check are one step: only the highest counts.
    steps = seen.groupBy("subject", "first_seen").agg(F.max("version").alias("version"))
    return (
        steps.selectExpr(
            "*", "max(version) OVER (PARTITION BY subject ORDER BY first_seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before"
        )
        .where(F.col("version") > F.col("before"))
        .select(
            F.lit("schema_evolution").alias("trigger_type"),
            F.regexp_replace("subject", "-value$", "").alias("source_topic"),
            F.col("first_seen").alias("triggered_at"),
        )
    )


def all_triggers(*producers: DataFrame) -> DataFrame:
    first, *rest = [p.select(*TRIGGER) for p in producers]
    for p in rest:
        first = first.unionByName(p)
    return first


def scan_keys(triggers: DataFrame, messages: DataFrame, minutes: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """(triggers, messages) with equi-join keys ``bucket`` and ``slot`` for a look-back.

    Messages fall into buckets of the look-back length and each trigger visits the
    two it can reach. Messages of one topic and bucket are dealt over ``salts``
    slots, and triggers copied to each, so that a topic with a third of all
    messages does not land in one task. The slot is that of the message's id.
    """
    width = minutes * 60 * 1_000_000

    def bucket(column: str):
        return F.expr(f"unix_micros({column}) div {width}")

    slot = F.pmod(F.xxhash64("msg_id" if "msg_id" in messages.columns else "event_time"), F.lit(salts)).cast("int")
    m = messages.withColumn("bucket", bucket("event_time")).withColumn("slot", slot)
    at = bucket("triggered_at")
    t = triggers.withColumn("at_bucket", F.explode(F.array(at, at - 1))).withColumn(
        "at_slot", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return t, m


def interval_scan(
    triggers: DataFrame, messages: DataFrame, minutes: int = SAMPLE_MINUTES, salts: int | None = None
) -> DataFrame:
    """Messages of the ``minutes`` before each trigger, both ends included (batch).

    Always an equi join by topic, bucket and slot, never a nested loop, and no job runs
    to plan it: Spark broadcasts the triggers where it finds them small. Unless given,
    ``salts`` is an eighth of the shuffle partitions, so a hot topic and minute spread
    over as large a part of the cluster.
    """
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t, m = scan_keys(triggers.select(*TRIGGER), messages, minutes, salts or max(1, parts // 8))
    near = F.unix_micros("triggered_at") - F.unix_micros("event_time")
    keys = (F.col("topic") == F.col("source_topic")) & (F.col("bucket") == F.col("at_bucket")) & (F.col("slot") == F.col("at_slot"))
    return (
        m.join(t, keys)
        .where(near.between(0, minutes * 60 * 1_000_000))
        .drop("bucket", "slot", "at_bucket", "at_slot")
    )


def in_reach(triggers: DataFrame, messages: DataFrame, minutes: int = SAMPLE_MINUTES) -> DataFrame:
    """The messages that ``interval_scan`` finds for any trigger, each once (batch).

    Of a bucket's triggers two decide: a message of the same bucket is in reach if it is not after the last one,
    one of the bucket before if it is within the look-back of the first one. So a topic and bucket has at most
    two rows here, however many triggers.
    """
    width = minutes * 60 * 1_000_000
    at, event = F.unix_micros("triggered_at"), F.unix_micros("event_time")
    # Rounded down before 1970, too.
    bucket = lambda c: F.expr(f"(unix_micros({c}) - pmod(unix_micros({c}), {width}L)) div {width}L")
    ends = triggers.groupBy("source_topic", bucket("triggered_at").alias("at_bucket")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    reach = ends.select(
        "source_topic",
        F.inline(F.array(
            F.struct(F.col("at_bucket").alias("at_bucket"), F.lit(None).cast("long").alias("since"), F.col("last").alias("until")),
            F.struct((F.col("at_bucket") - 1).alias("at_bucket"), (F.col("first") - width).alias("since"), F.lit(None).cast("long").alias("until")),
        )),
    )
    keys = (F.col("topic") == F.col("source_topic")) & (bucket("event_time") == F.col("at_bucket"))
    return messages.join(reach, keys & F.coalesce(event >= F.col("since"), event <= F.col("until")), "left_semi")


def scan_rows(messages: DataFrame, ids: list[str], max_layer: int = 3, **options) -> DataFrame:
    """The fields and tags of messages, with the topic and time that ``interval_scan`` joins by."""
    return classify_fields(messages, [*ids, "topic", "event_time"], max_layer, **options)


def scan_results(scanned: DataFrame, ids: list[str], max_layer: int = 3, **options) -> DataFrame:
    """Scan rows of joined messages, batch or stream: one per message, field and tag.

    A message that many triggers reach is classified for each of them. Where there are many,
    join its ``scan_rows`` instead: such rows (they have no ``value``) are taken as they are.
    """
    rows = classify_fields(scanned, [*ids, *TRIGGER], max_layer, **options) if "value" in scanned.columns else scanned
    return rows.select(
        *ids,
        "field_path",
        "tag",
        F.round("score", 2).alias("confidence"),
        "layer",
        "source",
        F.col("sample_value").alias("example"),
        "source_topic",
        "trigger_type",
        F.col("triggered_at").alias("scanned_at"),
    )


def append_results(results: DataFrame, path: str) -> None:
    """Append scan results, partitioned so that topic and date filters prune files."""
    (
        results.withColumn("scan_date", F.to_date("scanned_at"))
        .write.mode("append").partitionBy("source_topic", "scan_date").parquet(path)
    )


def read_results(spark: SparkSession, path: str, topic: str | None = None, today=None, days: int = RETENTION_DAYS) -> DataFrame:
    """Scan results of one topic within the retention, by partition pruning only."""
    results = spark.read.parquet(path)
    if topic is not None:
        results = results.where(F.col("source_topic") == topic)
    if today is not None:
        results = retained(results, today, days, "scan_date")
    return results


def retained(results: DataFrame, today, days: int = RETENTION_DAYS, column: str = "scanned_at") -> DataFrame:
    return results.where(F.to_date(column) > F.date_sub(F.to_date(F.lit(today)), days))
