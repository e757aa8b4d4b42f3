"""Routing messages by their tags, and the audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldscan.functions.taxonomy import clamp_layer_value, primary_tag
from fieldscan.operators.detect import DETECTION
from fieldscan.operators.inrow import message_sql
from fieldscan.plans.classify import CLASSIFIER_VERSION
from fieldscan.sources.messages import decode

_FIELD = f"struct<field_path:string,es:array<{DETECTION[:-1]},is_free_text:boolean>>>"
# Names of the sinks.
CLASSIFIED, SAFE, AUDIT = "classified-messages", "classified-safe", "classification-audit"


def with_classes(messages: DataFrame, max_layer: int | None = 3, schemas: DataFrame | None = None, **options) -> DataFrame:
    """Every message with its sorted ``tags``, ``entity_types_found`` and ``detected_entities``,
    the map of field to detections; empty where nothing is found.

    All of it is worked out in the message's row (see ``operators.inrow`` for the
    ``options``): nothing is joined, shuffled or read twice.
    """
    found = message_sql("payload", max_layer, **options)
    field = lambda x: F.struct(
        x["field_path"].alias("field_path"), F.transform(x["es"], lambda d: d.withField("is_free_text", x["is_free_text"])).alias("es")
    )
    keep = [F.col(f"`{c}`") for c in messages.columns]
    rows = decode(messages, schemas).select(*keep, F.expr(found).alias("_fields"))
    rows = rows.select(*keep, F.coalesce(F.sort_array(F.transform("_fields", field)), F.array().cast(f"array<{_FIELD}>")).alias("_found"))
    paths = F.array_distinct(F.transform("_found", lambda f: f["field_path"]))
    # Two spellings can flatten to one path; their lists are then joined.
    joined = F.map_from_arrays(
        paths,
        F.transform(
            paths, lambda p: F.flatten(F.transform(F.filter("_found", lambda f: f["field_path"] == p), lambda f: f["es"]))
        ),
    )
    entities = F.flatten(F.transform("_found", lambda f: f["es"]))
    return rows.select(
        *keep,
        F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["tag"]))).alias("tags"),
        F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["entity_type"]))).alias("entity_types_found"),
        F.when(F.size(paths) == F.size("_found"), F.map_from_entries("_found")).otherwise(joined).alias("detected_entities"),
        F.flatten(F.transform("_found", lambda f: F.array_distinct(F.transform(f["es"], lambda e: e["tag"])))).alias("field_tags"),
    )


def message_tags(messages: DataFrame, ids: list[str], max_layer: int | None = 3, **options) -> DataFrame:
    """Sorted distinct tags and entity types of each message that has any, and its primary tag."""
    rows = with_classes(messages, max_layer, **options)
    return _tagged(rows, *ids, "tags", "entity_types_found").withColumn("primary_tag", primary_tag(F.col("tags")))


def _tagged(rows: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the rows that have tags. By a generator: a filter would be pushed down and
    work everything out once more."""
    return rows.select(F.inline(F.when(F.size("tags") > 0, F.array(F.struct(*columns)))))


def route(messages: DataFrame, ids: list[str], max_layer: int = 3, **options) -> DataFrame:
    """Every message with its class and its sink; ``envelopes`` makes the rows to send.

    A message's class comes from its own value, so a redelivery under a used id keeps its own.
    """
    routed = (
        with_classes(messages, max_layer, **options).drop("field_tags")
        .withColumn("layers_used", F.sequence(F.lit(1), F.lit(clamp_layer_value(max_layer))))
        .withColumn("classified_at", F.current_timestamp())
        .withColumn("classifier_version", F.lit(CLASSIFIER_VERSION))
    )
    return routed.withColumn("sink_topic", F.when(F.size("tags") > 0, CLASSIFIED).otherwise(SAFE))


def envelopes(routed: DataFrame) -> DataFrame:
    """Rows (topic, key, value) for the message sinks."""
    payload = F.try_parse_json(F.col("value").cast("string"))
    body = F.struct(
        payload.alias("payload"),
        F.struct(
            "tags",
                "detected_entities",
            "classified_at",
            "classifier_version",
        ).alias("classification"),
    )
    return routed.where(payload.isNotNull()).select(
        F.col("sink_topic").alias("topic"), "key", F.to_json(body).alias("value")
    )


def audit_rows(routed: DataFrame, ids: list[str]) -> DataFrame:
    """One audit row per message, tagged or not."""
    return routed.select(*ids, "tags", "sink_topic", "classified_at", "entity_types_found")


def route_by_sql_map(messages: DataFrame, ids: list[str], max_layer: int = 3, **options) -> DataFrame:
    """Tagged messages only, as ``{payload, tags, classified_at}`` with a comma list.

    Messages with the same key and value share one row, as a GROUP BY on both does; its
    list names a tag for each field of each of them. ``digest`` of the pair stands for it
    in the grouping, and copies are counted before they are shuffled.
    """
    digest = F.sha2(F.to_json(F.struct("key", "value")), 256)
    rows = _tagged(with_classes(messages, max_layer, **options), "key", "value", "field_tags").withColumn("digest", digest)
    same = rows.groupBy("digest").agg(
        F.count("*").alias("n"), F.first("key").alias("key"), F.first("value").alias("payload"), F.first("field_tags").alias("own")
    )
    every = F.array_sort(F.flatten(F.transform(F.sequence(F.lit(1), F.col("n")), lambda _: F.col("own"))))
    lists = same.withColumn("tags", F.array_join(every, ","))
    fields = F.create_map(
        F.lit("payload"), F.col("payload").cast("string"),
        F.lit("tags"), F.col("tags"),
        F.lit("classified_at"), F.current_timestamp().cast("string"),
    )
    return lists.select("digest", "key", "tags", F.to_json(fields).alias("value"))
