"""Detections for SQL users: a table function, and views over message tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from fieldscan.operators.inrow import best_sql, detections_sql, folded_fields_sql, json_tree, let
from fieldscan.plans.classify import classify_fields

_BEST = "array<struct<field_path:string,tag:string,score:double,layer:int,source:string,snippet:string>>"


def create_detection_view(
    spark: SparkSession, source: str, view: str, ids: list[str], max_layer: int = 3, **options
) -> None:
    """Temp view ``view`` of the best detection per message, field and tag of table or
    view ``source`` (column ``value`` holds the message).

    It is planned with the query that reads it, so columns not asked for are pruned, and
    a view over a stream is a stream.
    """
    classify_fields(spark.table(source), ids, max_layer, **options).createOrReplaceTempView(view)


def best_hits_sql(max_layer: str = "max_layer", message: str = "message") -> str:
    """The best detection per field and tag of one message as an array, in one expression."""
    found = detections_sql(f"greatest(1, least(3, coalesce({max_layer}, 3)))")
    row = "named_struct('field_path', x.field_path, 'tag', d.tag, 'score', d.score, 'layer', d.layer, 'source', d.source, 'snippet', d.text_snippet)"
    best = let("x", found, f"cast(transform({best_sql('x.es')}, d -> {row}) AS {_BEST})")
    return f"flatten(transform({folded_fields_sql(json_tree(message))}, f -> {best}))"


def create_classify_function(spark: SparkSession, name: str = "classify_fields") -> None:
    """Temporary SQL table function ``name(max_layer, message)``, to be used under LATERAL.

    It returns ``field_path, tag, score, layer, source, sample_value``: the best detection per
    field and tag of one JSON message, fields at any depth, as ``classify_fields`` does. A
    null depth means all layers and others are clamped to 1..3. Null or unreadable
    messages have no rows. The body is one array expression that is exploded once, so
    messages are neither joined nor shuffled.
    """
    sample = "if(length(d.snippet) > 50, concat(substring(d.snippet, 1, 47), '...'), d.snippet)"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(max_layer INT, message STRING)
        RETURNS TABLE (field_path STRING, tag STRING, score DOUBLE, layer INT, source STRING, sample_value STRING)
        RETURN SELECT d.field_path, d.tag, d.score, d.layer, d.source, {sample} FROM explode({best_hits_sql()}) AS e(d)""")
