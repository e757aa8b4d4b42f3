"""The three detection layers over flat (field_path, value) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscan.functions.names import (
    free_text,
    keyword_rows,
    longest_keyword,
    name_hits,
    word_runs,
)
from fieldscan.functions.patterns import Pattern, with_pattern_hits
from fieldscan.functions.taxonomy import clamp_layer_value
from fieldscan.functions.text import leaf_name, name_words

DETECTION = (
    "struct<entity_type:string,tag:string,score:double,start:int,end:int,"
    "text_snippet:string,layer:int,source:string>"
)


def with_name_columns(flat: DataFrame, dictionary=None) -> DataFrame:
    """Add the leaf name, its words and its layer-1 hits."""
    return (
        flat.withColumn("leaf", leaf_name(F.col("field_path")))
        .withColumn("words", name_words(F.col("leaf")))
        .withColumn("name_hits", name_hits(F.col("words"), dictionary))
    )


def _from_names(value: Column, hits: Column) -> Column:
    return F.transform(
        hits,
        lambda h: F.struct(
            h["entity_type"].alias("entity_type"),
            h["tag"].alias("tag"),
            h["score"].alias("score"),
            F.lit(0).alias("start"),
            F.length(value).alias("end"),
            F.substring(value, 1, 80).alias("text_snippet"),
            F.lit(1).alias("layer"),
            F.lit("field_name").alias("source"),
        ),
    ).cast(f"array<{DETECTION}>")


def _from_patterns(value: Column, plain: Column, hits: Column) -> Column:
    return F.transform(
        hits,
        lambda h: F.struct(
            h["entity_type"].alias("entity_type"),
            h["tag"].alias("tag"),
            F.round(h["score"], 4).alias("score"),
            h["start"].alias("start"),
            h["stop"].alias("end"),
            F.when(plain == value, h["hit"])
            .otherwise(F.substring(value, h["start"] + 1, h["stop"] - h["start"]))
            .alias("text_snippet"),
            h["layer"].alias("layer"),
            h["source"].alias("source"),
        ),
    ).cast(f"array<{DETECTION}>")


def detect(
    flat: DataFrame,
    max_layer: int | None = 3,
    patterns: list[Pattern] | None = None,
    dictionary=None,
    language: str = "en",
    recognizers: list[Callable[[Column], Column]] | None = None,
    phrases: list[Pattern] | None = None,
    exclude_names: tuple[str, ...] = (),
    layer3_free_text_only: bool = False,
) -> DataFrame:
    """``flat`` with ``is_free_text`` and ``detections`` (empty where nothing is found).

    Everything is decided inside the row: no join, no shuffle, so the same call
    serves batch and streams. ``detections`` lists layer 1, then 2, then 3. Rows
    without detections fall out where the list is exploded; a filter on the list
    here would be pushed down and detect everything twice.
    ``phrases`` are layer-3 pattern rows, ``recognizers`` expressions that turn a
    value column into detections (see ``operators.entities``).
    """
    layers = clamp_layer_value(max_layer)
    keep = [c for c in flat.columns if c not in ("field_path", "value")]
    rows = with_name_columns(flat, dictionary)
    if exclude_names:
        rows = rows.where(~F.col("leaf").isin(*exclude_names))
    value = F.col("value")
    rows = rows.withColumn("is_free_text", free_text(F.col("words"), value, F.col("name_hits")))
    lists = [_from_names(value, F.col("name_hits"))]
    if layers >= 2:
        rows = with_pattern_hits(rows, "value", "hits2", patterns, language)
        rows = rows.withColumn("found2", _from_patterns(value, F.col("plain"), F.col("hits2")))
        lists.append(F.col("found2"))
    if layers >= 3:
        wanted = F.col("is_free_text") if layer3_free_text_only else F.lit(True)
        nothing = F.array().cast(f"array<{DETECTION}>")
        if phrases:
            rows = with_pattern_hits(rows, "value", "hits3", phrases, language, wanted)
            lists.append(_from_patterns(value, F.col("plain"), F.col("hits3")))
        for recognizer in recognizers or []:
            lists.append(F.coalesce(recognizer(F.when(wanted, value)).cast(f"array<{DETECTION}>"), nothing))
    return rows.select(*keep, "field_path", "value", "is_free_text", F.concat(*lists).alias("detections"))


def explode_detections(detected: DataFrame) -> DataFrame:
    """One row per detection; ``rank`` is its place in the field's list."""
    keep = [c for c in detected.columns if c not in ("value", "detections")]
    found = F.filter("detections", lambda d: d["tag"].isNotNull())
    return detected.select(*keep, F.posexplode(found).alias("rank", "d")).select(*keep, "rank", "d.*")


def _ranked(detections: Column) -> Column:
    return F.sort_array(
        F.transform(detections, lambda d, i: F.struct((-d["score"]).alias("down"), i.alias("rank"), d.alias("d")))
    )


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first_of_each(detections: Column, kind: Callable[[Column], Column]) -> Column:
    def pick(ranked: Column) -> Column:
        kinds = F.array_distinct(F.transform(ranked, lambda r: kind(r["d"])))
        return F.transform(kinds, lambda k: F.get(F.filter(ranked, lambda r: kind(r["d"]) == k), F.lit(0))["d"])

    return F.when(F.size(detections) > 1, _named(_ranked(detections), pick)).otherwise(detections)


def best_per_tag(detections: Column) -> Column:
    """Best detection of each tag in one field's list; the first of equals wins."""
    return _first_of_each(detections, lambda d: d["tag"])


def best_per_entity(detections: Column) -> Column:
    """Best detection of each (tag, entity type) in one field's list, best first."""
    return _first_of_each(detections, lambda d: F.struct(d["tag"], d["entity_type"]))


def classify_names(names: DataFrame, column: str = "field_path", dictionary=None) -> DataFrame:
    """Layer 1 as a join: every distinct name with its dictionary hits.

    ``(name, entity_type, tag, score, matched_keyword)``, one row per hit. Names
    are made distinct first, so the work follows the vocabulary and not the rows;
    the dictionary side is a fixed table of under 200 keywords.
    """
    spark = names.sparkSession
    keywords = spark.createDataFrame(
        keyword_rows(dictionary),
        "ord int, entity_type string, tag string, score double, kw_ord int, matched_keyword string, run string",
    )
    runs = (
        names.select(F.col(column).alias("name"))
        .distinct()
        .withColumn("words", name_words(leaf_name(F.col("name"))))
        .select("name", F.explode(F.array_distinct(word_runs(F.col("words"), longest_keyword(dictionary)))).alias("run"))
    )
    return (
        runs.join(F.broadcast(keywords), "run")
        .groupBy("name", "entity_type", "tag", "score")
        .agg(F.min_by("matched_keyword", "kw_ord").alias("matched_keyword"))
    )


