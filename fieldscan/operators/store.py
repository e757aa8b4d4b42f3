"""The recommendation store as a table of buckets, and the scan results as a log of days.

Both change by manifests (see ``sources.manifest``). A batch of recommendations rewrites the
buckets that its keys fall into and no others; results expire by leaving the manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscan.operators import review
from fieldscan.operators.scan import RETENTION_DAYS
from fieldscan.sources import manifest
from fieldscan.sources.manifest import Conflict

BUCKETS = 64
RESULT = (
    "field_path string, tag string, confidence double, layer int, source string, example string, "
    "source_topic string, trigger_type string, scanned_at timestamp"
)
# A day's parts are merged when they are more than this.
MOST_PARTS = 8


class Recommendations:
    """Copy-on-write by bucket of the row's id; ``buckets`` is fixed when a store is made."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def bucket(self, rec_id):
        return F.pmod(F.xxhash64(rec_id), F.lit(self.buckets)).cast("int")

    def snapshot(self, version: int | None = None, only: set[str] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        listed = manifest.entries(self.spark, self.root, version)[1]
        return manifest.read(self.spark, review.SCHEMA, [e for e in listed if only is None or e["bucket"] in only])

    def change(self, touched: DataFrame, next_rows: Callable[[DataFrame], DataFrame], tries: int = 5, base: int | None = None) -> int:
        """Replace the buckets of the ids ``touched(id)`` by ``next_rows`` of what they hold.

        If another writer was faster, the work is kept where its buckets are others than
        those; else it is done again on the new rows, at most ``tries`` times. ``base``
        is the version to start from, the newest unless given.
        """
        hit = {str(r["b"]) for r in touched.select(self.bucket(F.col("id")).alias("b")).distinct().collect()}
        made: list[dict] | None = None
        before: dict[str, str] = {}
        for _ in range(tries):
            base, listed = manifest.entries(self.spark, self.root, base)
            now = {e["bucket"]: e["path"] for e in listed if e["bucket"] in hit}
            if made is None or now != before:
                old = manifest.read(self.spark, review.SCHEMA, [e for e in listed if e["bucket"] in hit])
                rows = next_rows(old).withColumn("bucket_", self.bucket(F.col("id")))
                rows = rows.repartition(max(1, len(hit)), "bucket_")
                made, before = manifest.put(rows, self.root, {"bucket": "bucket_"}), now
            try:
                return manifest.commit(self.spark, self.root, base, [*(e for e in listed if e["bucket"] not in hit), *made])
            except Conflict:
                base = None
        raise Conflict(self.root)

    def upsert(self, incoming: DataFrame, now, **options) -> int:
        """``review.upsert`` of the buckets that the batch's keys fall into.

        Its best rows per key are kept meanwhile: they are asked for their keys first, and the batch
        behind them, often a scan of all messages, is worked out once.
        """
        best = review.best_incoming(incoming).persist()
        try:
            return self.change(best.select(review.rec_id().alias("id")), lambda old: review.upsert(old, best, now), **options)
        finally:
            best.unpersist()

    def decide(self, decisions: DataFrame, **options) -> int:
        """``review.apply_decisions`` of the buckets that the decisions name."""
        ids = decisions.select(F.col("rec_id").alias("id")).distinct()
        return self.change(ids, lambda old: review.apply_decisions(old, decisions)[0], **options)


class Results:
    """Scan results by topic and day, appended, merged and expired by manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _retry(self, change: Callable[[list[dict]], list[dict]], tries: int = 5) -> int:
        for _ in range(tries):
            base, listed = manifest.entries(self.spark, self.root)
            try:
                return manifest.commit(self.spark, self.root, base, change(listed))
            except Conflict:
                continue
        raise Conflict(self.root)

    def append(self, results: DataFrame) -> int:
        rows = results.select(*(c.split()[0] for c in RESULT.split(", "))).withColumn("day_", F.to_date("scanned_at"))
        made = manifest.put(rows, self.root, {"topic": "source_topic", "day": "day_"})
        return self._retry(lambda listed: [*listed, *made])

    def expire(self, today: str, days: int = RETENTION_DAYS) -> int:
        """Days that are ``days`` old or older leave the manifest; no file is read or rewritten."""
        first = str(self.spark.range(1).select(F.date_sub(F.to_date(F.lit(today)), days - 1)).first()[0])
        return self._retry(lambda listed: [e for e in listed if e["day"] >= first])

    def compact(self, most: int = MOST_PARTS) -> int:
        """Topic days of more than ``most`` parts become one part each; others are left alone."""
        _, listed = manifest.entries(self.spark, self.root)
        groups: dict[tuple[str, str], list[dict]] = {}
        for e in listed:
            groups.setdefault((e["topic"], e["day"]), []).append(e)
        many = [e for own in groups.values() if len(own) > most for e in own]
        if not many:
            return 0
        rows = manifest.read(self.spark, RESULT, many).withColumn("day_", F.to_date("scanned_at")).repartition("source_topic", "day_")
        made, gone = manifest.put(rows, self.root, {"topic": "source_topic", "day": "day_"}), {e["path"] for e in many}

        def swap(now: list[dict]) -> list[dict]:
            # What has expired meanwhile is not brought back.
            left = {(e["topic"], e["day"]) for e in now if e["path"] in gone}
            return [*(e for e in now if e["path"] not in gone), *(e for e in made if (e["topic"], e["day"]) in left)]

        return self._retry(swap)

    def read(self, topic: str | None = None, since: str | None = None) -> DataFrame:
        """Results of the newest version, of one topic or from a day on, by the manifest alone."""
        _, listed = manifest.entries(self.spark, self.root)
        return manifest.read(self.spark, RESULT, [e for e in listed if (topic is None or e["topic"] == topic) and (since is None or e["day"] >= since)])

    def parts(self) -> int:
        return len(manifest.entries(self.spark, self.root)[1])
