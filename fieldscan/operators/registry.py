"""Schemas as tables: fields, tags, versions, and tags written back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldscan.functions.taxonomy import tag_definitions
from fieldscan.functions.text import qualified_name, schema_path, subject_of
from fieldscan.operators.rollup import merged_tags

# schemas(subject, version, id, schema_type, schema)
FIELD_ROWS = "subject string, version int, field_path string, tags array<string>"
FIELD_TYPE = "sr_field"


def _tags(field: dict) -> list[str]:
    """Tags of a field: the property ``tags``, plain or under a vendor prefix."""
    found = [v for k, v in field.items() if k.split(":")[-1] == "tags" and isinstance(v, list)]
    return [t for tags in found for t in tags]


def _avro_fields(schema) -> Iterator[tuple[str, list[str]]]:
    todo = [("", schema)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, list):
            todo += [(path, branch) for branch in node]
        elif isinstance(node, dict) and node.get("type") == "record":
            for field in node.get("fields") or []:
                if field.get("name"):
                    child = f"{path}.{field['name']}".lstrip(".")
                    yield child, _tags(field)
                    todo.append((child, field.get("type")))
        elif isinstance(node, dict):
            inner = {"array": node.get("items"), "map": node.get("values")}
            kind = node.get("type")
            todo.append((path, inner.get(kind) if isinstance(kind, str) else kind))


def _json_schema_fields(schema) -> Iterator[tuple[str, list[str]]]:
    todo = [("", schema)]
    while todo:
        path, node = todo.pop()
        if not isinstance(node, dict):
            continue
        for name, field in (node.get("properties") or {}).items():
            child = f"{path}.{name}".lstrip(".")
            yield child, _tags(field)
            todo.append((child, field))
        if isinstance(node.get("items"), dict):
            todo.append((path, node["items"]))


_READERS = {"AVRO": _avro_fields, "JSON": _json_schema_fields}


def _fields_of(text: str | None, kind: str | None) -> list[tuple[str, list[str]]]:
    """Fields of one schema text, each path once; nothing if it cannot be read."""
    merged: dict[str, list[str]] = {}
    try:
        for path, tags in _READERS[(kind or "AVRO").upper()](json.loads(text)):
            merged[path] = list(dict.fromkeys([*merged.get(path, []), *tags]))
    except (KeyError, TypeError, ValueError, AttributeError):
        return []
    return list(merged.items())


def _walked(schemas: DataFrame) -> DataFrame:
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (r.subject, r.version, path, tags)
                for r in batch.itertuples(index=False)
                for path, tags in _fields_of(r.schema, r.schema_type)
            ]
            yield pd.DataFrame(rows, columns=["subject", "version", "field_path", "tags"])

    return schemas.select("subject", F.col("version").cast("int"), "schema_type", "schema").mapInPandas(walk, FIELD_ROWS)


def schema_fields(schemas: DataFrame) -> DataFrame:
    """Every dotted field path of every Avro schema; unreadable schemas have none."""
    avro = schemas.where(F.upper(F.coalesce("schema_type", F.lit("AVRO"))) == "AVRO")
    return _walked(avro).select("subject", "version", "field_path")


def field_tags(schemas: DataFrame) -> DataFrame:
    """(subject, version, field_path, tag) already on Avro or JSON schemas."""
    return _walked(schemas).select("subject", "version", "field_path", F.explode("tags").alias("tag"))


def record_qualifier(schema: Column) -> Column:
    """``namespace.name`` of a record schema text; the name alone without namespace."""
    name, namespace = F.get_json_object(schema, "$.name"), F.get_json_object(schema, "$.namespace")
    return F.when(
        F.length(name) > 0, F.when(F.length(namespace) > 0, F.concat_ws(".", namespace, name)).otherwise(name)
    )


def top_level_fields(schemas: DataFrame) -> DataFrame:
    """Top-level field names in order, or the problem that rules a schema out."""
    body = F.from_json("schema", "struct<type:string,fields:array<struct<name:string>>>")
    kind = F.upper(F.coalesce("schema_type", F.lit("AVRO")))
    names = F.filter(F.transform(F.col("body.fields"), lambda f: f["name"]), lambda n: n.isNotNull())
    return (
        schemas.withColumn("body", body)
        .withColumn("names", names)
        .withColumn(
            "problem",
            F.when(kind != "AVRO", F.concat(F.lit("schema type not supported: "), kind))
            .when(F.coalesce(F.length("schema"), F.lit(0)) == 0, "schema missing")
            .when(F.coalesce(F.col("body.type"), F.lit("")) != "record", "not a record schema")
            .when(F.coalesce(F.size("names"), F.lit(0)) <= 0, "record has no fields"),
        )
        .select("subject", "version", F.when(F.col("problem").isNull(), F.col("names")).alias("names"), "problem")
    )


def latest_schema(schemas: DataFrame) -> DataFrame:
    rest = [c for c in schemas.columns if c != "subject"]
    return (
        schemas.groupBy("subject").agg(F.max_by(F.struct(*rest), "version").alias("s")).select("subject", "s.*")
    )


def schema_diff(fields: DataFrame, old: int | Column, new: int | Column) -> DataFrame:
    """Paths added or removed between two versions of each subject."""
    def side(version):
        version = F.lit(version) if isinstance(version, int) else version
        return fields.where(F.col("version") == version).select("subject", "field_path").distinct()

    a, b = side(old).withColumn("was", F.lit(True)), side(new).withColumn("now", F.lit(True))
    return (
        a.join(b, ["subject", "field_path"], "full")
        .where(F.col("was").isNull() | F.col("now").isNull())
        .select("subject", "field_path", F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"))
    )


def stamp_schema(rows: DataFrame, schemas: DataFrame, topic: str = "source_topic") -> DataFrame:
    """Rows with the id of their topic's current schema, null when unknown."""
    current = latest_schema(schemas).select(F.col("subject"), F.col("id").alias("schema_id"))
    return rows.withColumn("subject", subject_of(F.col(topic))).join(current, "subject", "left")


def validated(recs: DataFrame, schemas: DataFrame, fields: DataFrame, strict_paths: bool = False) -> DataFrame:
    """Recommendations with the schema version they resolve to and, where one fails,
    the reason it would be dropped. With an id the match is exact; without, latest."""
    by_id = schemas.groupBy("subject", F.col("id").alias("schema_id")).agg(F.min("version").alias("id_version"))
    newest = schemas.groupBy("subject").agg(F.max("version").alias("last_version"))
    meta = schemas.select(
        "subject", "version", F.col("id").alias("version_id"), record_qualifier(F.col("schema")).alias("qualifier")
    )
    known = fields.select("subject", "version").distinct().withColumn("readable", F.lit(True))
    paths = fields.select("subject", "version", F.col("field_path").alias("clean_path")).distinct().withColumn("listed", F.lit(True))
    version = F.when(F.col("schema_id").isNull(), F.col("last_version")).otherwise(F.col("id_version"))
    checked = (
        recs.join(by_id, ["subject", "schema_id"], "left")
        .join(newest, "subject", "left")
        .withColumn("version", version)
        .withColumn("clean_path", schema_path(F.col("field_path"), strict_paths))
        .join(meta, ["subject", "version"], "left")
        .join(known, ["subject", "version"], "left")
        .join(paths, ["subject", "version", "clean_path"], "left")
    )
    # Why a row is dropped.
    reason = (
        F.when(F.col("version").isNull(), "could not resolve schema version in SR")
        .when(F.col("readable").isNull() | F.col("version_id").isNull() | F.col("qualifier").isNull(), "could not fetch/parse SR schema")
        .when(F.col("listed").isNull(), "field not in current SR schema")
    )
    return checked.withColumn("reason", reason).drop("id_version", "last_version", "readable", "listed")


def catalog_rows(valid: DataFrame, cluster: str) -> DataFrame:
    """One catalog entry per valid (field, tag), ready to be written in one batch."""
    name = qualified_name(F.lit(cluster), F.col("version_id"), F.col("qualifier"), F.col("clean_path"))
    return valid.where(F.col("reason").isNull()).select(
        F.lit(FIELD_TYPE).alias("entityType"), name.alias("entityName"), F.col("proposed_tag").alias("typeName")
    )


def missing_tag_definitions(spark: SparkSession, existing: DataFrame) -> DataFrame:
    return tag_definitions(spark).join(existing.select("name"), "name", "left_anti")


def apply_tags(schemas: DataFrame, approvals: DataFrame) -> DataFrame:
    """Tags of every field after the approved ones are merged in, as one new version.

    ``approvals(subject, field_path, tag)``. Paths a schema does not list are
    ignored, tags already there are not doubled, and a subject that gains nothing
    keeps its version. ``(subject, version, field_path, tags)``.
    """
    newest = latest_schema(schemas)
    current = _walked(newest)
    wanted = approvals.groupBy("subject", "field_path").agg(F.array_sort(F.collect_set("tag")).alias("new_tags"))
    merged = current.join(wanted, ["subject", "field_path"], "left").withColumn("after", merged_tags(F.col("tags"), F.col("new_tags")))
    # Fields of one subject's newest schema: a window no larger than a schema.
    gains = F.max((F.size("after") > F.size("tags")).cast("int")).over(Window.partitionBy("subject"))
    return merged.withColumn("gains", gains).select(
        "subject", (F.col("version") + F.col("gains")).alias("version"), "field_path", F.col("after").alias("tags")
    )


def tag_columns(table: DataFrame, tags: dict[str, list[str]]) -> DataFrame:
    """A table whose columns carry their tags as metadata."""
    for column, names in tags.items():
        if column in table.columns:
            old = table.schema[column].metadata
            merged = list(dict.fromkeys([*old.get("tags", []), *names]))
            table = table.withMetadata(column, {**old, "tags": merged})
    return table
