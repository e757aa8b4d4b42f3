"""Roll-ups over detections and scan results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscan.functions.taxonomy import ALERT_SCORE, ALERT_TAGS, TAGS


def best_per_field_tag(detections: DataFrame, ids: list[str]) -> DataFrame:
    """Best row per (message, field, tag) of long detections.

    Equal scores go to the lower ``rank``, that is layer order, then place in the
    layer. A plain aggregate: partial on the map side, whatever the key's size.
    ``detect.best_per_tag`` does the same inside a row when the list is at hand.
    """
    return _best(detections, [*ids, "field_path", "tag"])


def _best(detections: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in detections.columns if c not in keys]
    order = F.struct((-F.col("score")).alias("down"), F.col("rank"))
    return detections.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("b")).select(*keys, "b.*")


def tag_list(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Comma list of the tags of a key, not distinct, in tag order.

    Counted per tag before the list is built, so a key that holds a third of the
    rows still shuffles at most one short row per tag and task.
    """
    counted = rows.groupBy(*keys, "tag").agg(F.count(F.lit(1)).cast("int").alias("n"))
    lists = counted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("tag", "n"))).alias("t"))
    text = F.array_join(
        F.transform("t", lambda x: F.concat(x["tag"], F.repeat(F.concat(F.lit(","), x["tag"]), x["n"] - 1))), ","
    )
    return lists.select(*keys, text.alias("tags"))


def field_profile(rows: DataFrame) -> DataFrame:
    """Detections, mean confidence and earliest layer per field and tag."""
    return (
        rows.groupBy("field_path", "tag")
        .agg(
            F.count(F.lit(1)).alias("detections"),
            F.round(F.avg("score"), 3).alias("avg_confidence"),
            F.min("layer").alias("earliest_layer"),
        )
        .orderBy(F.desc("detections"), "field_path", "tag")
    )


def tag_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag")


def tag_matrix(rows: DataFrame, source: str = "topic") -> DataFrame:
    """Which sources carry which tags: one flag column per tag."""
    flags = [F.max((F.col("tag") == t).cast("int")).alias(t) for t in TAGS]
    return rows.groupBy(source).agg(*flags)


def alerts(rows: DataFrame, tags: list[str] | None = None, min_score: float = ALERT_SCORE) -> DataFrame:
    """Rows of the tags that alert, at or over the floor. Works on streams."""
    return rows.where(F.col("tag").isin(*(ALERT_TAGS if tags is None else tags)) & (F.col("score") >= min_score))


def latest_batch(results: DataFrame) -> DataFrame:
    """Rows of the newest scan of each source topic.

    One maximum per topic (partial on the map side) joined back on topic and
    time, so a topic with a third of the rows is not one window partition.
    """
    newest = results.groupBy("source_topic").agg(F.max("scanned_at").alias("scanned_at"))
    return results.join(newest, ["source_topic", "scanned_at"], "left_semi")


def latest_best(results: DataFrame) -> DataFrame:
    """Newest scan, best confidence per (topic, field, tag), best first."""
    keys = ["source_topic", "field_path", "tag"]
    rest = [c for c in results.columns if c not in keys]
    order = F.struct((-F.unix_micros("scanned_at")).alias("age"), (-F.col("confidence")).alias("down"), "layer", "source", "example")
    # One pass: of each field and tag its newest scan's best row, whatever the number of scans;
    # only those rows, one per field and tag, meet in the window that finds a topic's newest scan.
    best = results.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("b")).select(*keys, "b.*")
    newest = F.max("scanned_at").over(Window.partitionBy("source_topic"))
    best = best.withColumn("newest", newest).where(F.col("scanned_at") == F.col("newest"))
    return best.select(*results.columns).orderBy(F.desc("confidence"), *keys)


def split_new(rows: DataFrame, field_tags: DataFrame, extra: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new, already there) by field and tag against the tags a schema carries.

    For both at once take ``with_known``, which works the rows out only once.
    """
    flagged = with_known(rows, field_tags, extra)
    return flagged.where(~F.col("known")).drop("known"), flagged.where("known").drop("known")


def with_known(rows: DataFrame, field_tags: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``rows`` with ``known``: does a schema carry that field's tag already?"""
    keys = [*(extra or []), "field_path", "tag"]
    there = field_tags.select(*keys).distinct().withColumn("known", F.lit(True))
    return rows.join(there, keys, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def merged_tags(existing: Column, new: Column) -> Column:
    """Union of two tag lists: order kept, no doubles."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(existing, empty), F.coalesce(new, empty)))


def newest_first(rows: DataFrame, n: int, ids: list[str]) -> DataFrame:
    """The ``n`` newest detections, the most certain first within one moment, with their ``place``."""
    order = [F.desc("event_time"), F.desc("score"), *ids, "field_path", "tag"]
    top = rows.orderBy(*order).limit(n)
    # The window sees the n rows only.
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
