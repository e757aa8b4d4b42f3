"""From messages or tables to detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldscan.functions.taxonomy import clamp_layer_value
from fieldscan.functions.text import scan_example
from fieldscan.operators.detect import best_per_tag, classify_names, detect, explode_detections
from fieldscan.operators.entities import gazetteer, gazetteer_patterns, phrase_recognizer
from fieldscan.operators.flatten import flatten_variant, schema_leaves
from fieldscan.sources.messages import decode

CLASSIFIER_VERSION = "fieldscan-2"
# Ranks of phrase-table hits start here, behind every other hit of a field.
PHRASE_RANK = 1_000_000


def detect_messages(
    messages: DataFrame, ids: list[str], max_layer: int | None = 3, schemas=None, **options
) -> DataFrame:
    """Fields of JSON (or wire-format) messages with their detections. Tombstones and
    unreadable messages have no leaves, so they fall out without a filter."""
    options.setdefault("phrases", gazetteer_patterns())
    flat = flatten_variant(decode(messages, schemas), ids)
    return detect(flat, max_layer, **options)


def classify(
    messages: DataFrame, ids: list[str], max_layer: int | None = 3, phrase_table: DataFrame | None = None, **options
) -> DataFrame:
    """One row per detection of each message field.

    ``phrase_table(phrase, label, score)`` adds the phrases of a table of any size to
    layer 3 (see ``entities.gazetteer``); its hits come after the others of a field. Unless
    the table is too large for the row, messages are read once.
    """
    layers = clamp_layer_value(max_layer)
    found = phrase_recognizer(phrase_table) if phrase_table is not None and layers >= 3 else None
    if found is not None:
        options["recognizers"] = [*(options.get("recognizers") or []), found]
    detected = detect_messages(messages, ids, max_layer, **options)
    rows = explode_detections(detected)
    if phrase_table is None or layers < 3 or found is not None:
        return rows
    hits = gazetteer(detected, phrase_table, [*ids, "is_free_text"])
    hits = hits.withColumn("rank", F.col("rank") + F.lit(PHRASE_RANK))
    return rows.unionByName(hits.select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]))


def best_rows(detected: DataFrame, ids: list[str]) -> DataFrame:
    """Best detection per (message, field, tag), decided inside the row."""
    return detected.select(
        *ids, "field_path", "is_free_text", F.explode(best_per_tag(F.col("detections"))).alias("d")
    ).select(*ids, "field_path", "is_free_text", "d.*")


def classify_fields(messages: DataFrame, ids: list[str], max_layer: int | None = 3, **options) -> DataFrame:
    """``ids + (field_path, tag, score, layer, source, sample_value)``, one row per
    field and tag of a message."""
    best = best_rows(detect_messages(messages, ids, max_layer, **options), ids)
    return best.select(
        *ids, "field_path", "tag", "score", "layer", "source", scan_example(F.col("text_snippet")).alias("sample_value")
    )


def classify_schema(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """Layer 1 over the fields of a table's schema: no data is read."""
    paths = spark.createDataFrame([(p,) for p in schema_leaves(schema)], "field_path string")
    return classify_names(paths)
