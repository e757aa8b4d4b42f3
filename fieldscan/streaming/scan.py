"""The scan on streams: triggers, interval join, schema watch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldscan.operators.scan import SAMPLE_MINUTES, SCAN_MINUTES, TRIGGER, scan_keys, scheduled_triggers
from fieldscan.sources.manifest import listed

# How late a trigger may come, and the seconds between two checks.
TRIGGER_DELAY = "10 seconds"
CHECK_SECONDS = 60
# Checked seconds wait in the state by the day; so many of one subject are gathered before they go there.
DAY, HELD_SECONDS = 86_400, 500_000


def with_event_time(messages: DataFrame, delay: str = TRIGGER_DELAY, column: str = "event_time") -> DataFrame:
    return messages.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def scheduled_trigger_stream(messages: DataFrame, minutes: int = SCAN_MINUTES, delay: str = TRIGGER_DELAY) -> DataFrame:
    """A trigger as each window closes. The open window waits for the watermark.

    ``closes_at`` is the window's own event time, which carries the watermark on.
    """
    return scheduled_triggers(with_event_time(messages, delay), minutes, with_event_time=True)


def interval_scan_stream(
    triggers: DataFrame, messages: DataFrame, minutes: int = SAMPLE_MINUTES, delay: str = TRIGGER_DELAY, salts: int | None = None
) -> DataFrame:
    """Messages of the look-back before each trigger, both sides streaming.

    ``triggers`` carry a watermark already: scheduled ones on ``closes_at``, others on
    ``triggered_at`` from ``with_event_time(triggers, column="triggered_at")``. State
    is spread by topic, time bucket and slot, and the time bound lets Spark drop it
    as the watermarks pass; a message later than the watermark joins nothing. Slots are
    an eighth of the shuffle partitions unless given, as in the batch form; a stream
    keeps the number that it started with in its checkpoint.
    """
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t, m = scan_keys(triggers, with_event_time(messages, delay), minutes, salts or max(1, parts // 8))
    # A window's event time is one microsecond before its end.
    at = "(closes_at + INTERVAL 1 MICROSECOND)" if "closes_at" in triggers.columns else "triggered_at"
    keys = "topic = source_topic AND bucket = at_bucket AND slot = at_slot"
    bound = f"event_time >= {at} - INTERVAL {minutes} MINUTES AND event_time <= {at}"
    return m.join(t, F.expr(f"{keys} AND {bound}")).drop("bucket", "slot", "at_bucket", "at_slot")


def manual_trigger_stream(requests: DataFrame, delay: str = TRIGGER_DELAY) -> DataFrame:
    """``manual`` triggers from ``requests(topic, requested_at)``, under the same watermark as the others."""
    rows = requests.select(F.lit("manual").alias("trigger_type"), F.col("topic").alias("source_topic"), F.col("requested_at").cast("timestamp").alias("triggered_at"))
    return with_event_time(rows, delay, "triggered_at")


def start_triggers(triggers: DataFrame, path: str, checkpoint: str, producer: str, every: str | None = None) -> StreamingQuery:
    """Append one producer's triggers to the trigger log, each (type, topic, time) once.

    A replayed micro-batch replaces itself. A producer that starts anew, without its
    checkpoint, meets its own triggers in the log and adds none twice; days are folders,
    so only those of the batch are read.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*TRIGGER).withColumn("day", F.to_date("triggered_at").cast("string")).dropDuplicates(TRIGGER).persist()
        try:
            days = {f"day={r['day']}" for r in rows.select("day").distinct().collect()}
            run = f"run={producer}-{checkpoint_id}-{batch_id}"
            runs = [n for n in listed(spark, path) if n.startswith(f"run={producer}-") and n != run]
            known = [f"{path}/{n}/{d}" for n in runs for d in listed(spark, f"{path}/{n}") if d in days]
            fresh = rows.join(spark.read.schema(_TRIGGER).parquet(*known), TRIGGER, "left_anti") if known else rows
            fresh.coalesce(1).write.mode("overwrite").partitionBy("day").parquet(f"{path}/{run}")
        finally:
            rows.unpersist()

    checkpoint_id = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    writer = triggers.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


_TRIGGER = "trigger_type string, source_topic string, triggered_at timestamp"


def trigger_log(spark: SparkSession, path: str) -> DataFrame:
    """All triggers written, for a batch scan; ``spark.readStream`` of the same folder feeds a stream."""
    return spark.read.schema(_TRIGGER).option("recursiveFileLookup", "true").parquet(path)


def trigger_log_stream(spark: SparkSession, path: str, delay: str = TRIGGER_DELAY) -> DataFrame:
    """The trigger log as a stream, ready for ``interval_scan_stream``."""
    rows = spark.readStream.schema(_TRIGGER).option("recursiveFileLookup", "true").parquet(path)
    return with_event_time(rows, delay, "triggered_at")


class _VersionWatch(StatefulProcessor):
    """Per subject: the highest version seen and the time of the last check."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", "version int, checked_at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, last = self._seen.get() if self._seen.exists() else (None, None)
        # A batch's checks shrink to one per second, so memory follows time, not rows.
        checks: dict[pd.Timestamp, int] = {}
        for batch in rows:
            top = batch["version"].groupby(batch["checked_at"].dt.floor("s")).max()
            for at, version in top.items():
                checks[at] = max(int(version), checks.get(at, 0))
        fired = []
        for at in sorted(checks):
            if last is not None and (at - pd.Timestamp(last)).total_seconds() < CHECK_SECONDS:
                continue
            last = at.to_pydatetime()
            if known is not None and checks[at] > known:
                fired.append((key[0], at))
            known = max(checks[at], known or 0)
        if last is not None:
            self._seen.update((int(known), last))
        yield pd.DataFrame(fired, columns=["subject", "triggered_at"])

    def close(self) -> None:
        pass


def schema_change_stream(checks: DataFrame) -> DataFrame:
    """``schema_evolution`` triggers from ``checks(subject, version, checked_at)``.

    State is kept per subject, so subjects are watched in parallel. Needs the
    RocksDB state store (``session.configure`` sets it).
    """
    fired = checks.groupBy("subject").transformWithStateInPandas(
        statefulProcessor=_VersionWatch(),
        outputStructType="subject string, triggered_at timestamp",
        outputMode="append",
        timeMode="none",
    )
    return fired.select(
        F.lit("schema_evolution").alias("trigger_type"),
        F.regexp_replace("subject", "-value$", "").alias("source_topic"),
        "triggered_at",
    )


class _TimedWatch(StatefulProcessor):
    """Per subject: the seconds that were checked and have not yet been passed by the watermark, packed
    by the day, with a timer at a day's first one; and the highest version and the last check before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._due = handle.getMapState("days", "day long", "seconds binary, versions binary")
        self._seen = handle.getValueState("seen", "version int, checked_at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held, size = [], 0
        for batch in rows:
            known = batch[["checked_at", "version"]].dropna()
            seconds = known["checked_at"].dt.floor("s").to_numpy("datetime64[s]").astype("int64")
            late = seconds * 1000 <= passed
            held.append(_newest(seconds[~late], known["version"].to_numpy("int64")[~late]))
            size += len(held[-1][0])
            if size > HELD_SECONDS:
                self._keep(held)
                held, size = [], 0
        self._keep(held)
        yield _no_triggers()

    def _keep(self, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Adds checked seconds to their days; a day is read and written once."""
        if not held:
            return
        seconds, versions = _newest(*(np.concatenate(x) for x in zip(*held)))
        days, first = np.unique(seconds // DAY, return_index=True)
        for day, a, b in zip(days.tolist(), first, [*first[1:], len(seconds)]):
            own, timer = (seconds[a:b], versions[a:b]), None
            if self._due.containsKey((day,)):
                there = _unpacked(self._due.getValue((day,)))
                own, timer = _newest(*(np.concatenate(x) for x in zip(there, own))), int(there[0][0])
            if timer != int(own[0][0]):
                if timer is not None:
                    self._handle.deleteTimer(timer * 1000)
                self._handle.registerTimer(int(own[0][0]) * 1000)
            self._due.updateValue((day,), _packed(*own))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        day = at // (1000 * DAY)
        seconds, versions = _unpacked(self._due.getValue((day,)))
        passed = int(np.searchsorted(seconds, max(at, timerValues.getCurrentWatermarkInMs()) // 1000, "right"))
        if passed < len(seconds):
            self._due.updateValue((day,), _packed(seconds[passed:], versions[passed:]))
            self._handle.registerTimer(int(seconds[passed]) * 1000)
        else:
            self._due.removeKey((day,))
        known, last = self._seen.get() if self._seen.exists() else (None, None)
        fired, i = [], 0
        while i < passed:
            second, version = int(seconds[i]), int(versions[i])
            if last is not None and 1000 * second - last < 1000 * CHECK_SECONDS:
                i = int(np.searchsorted(seconds, -(-(last + 1000 * CHECK_SECONDS) // 1000)))
                continue
            if known is not None and version > known:
                fired.append((key[0], pd.Timestamp(second, unit="s")))
            known, last = max(version, known or 0), 1000 * second
            i += 1
        if passed and last is not None:
            self._seen.update((known, last))
        if fired:
            yield pd.DataFrame(fired, columns=["subject", "triggered_at"])

    def close(self) -> None:
        pass


def _newest(seconds: np.ndarray, versions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each second once, in order, with its highest version."""
    order = np.lexsort((versions, seconds))
    seconds, versions = seconds[order], versions[order]
    last = np.flatnonzero(np.r_[seconds[1:] != seconds[:-1], True][: len(seconds)])
    return seconds[last], versions[last]


def _packed(seconds: np.ndarray, versions: np.ndarray) -> tuple[bytes, bytes]:
    return seconds.astype("<i8").tobytes(), versions.astype("<i4").tobytes()


def _unpacked(row: tuple) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(bytes(row[0]), "<i8"), np.frombuffer(bytes(row[1]), "<i4").astype("int64")


def _no_triggers() -> pd.DataFrame:
    return pd.DataFrame({"subject": pd.Series([], dtype="str"), "triggered_at": pd.Series([], dtype="datetime64[ns]")})


def schema_watch_stream(checks: DataFrame, delay: str = TRIGGER_DELAY) -> DataFrame:
    """``schema_change_stream`` by event time: checks are looked at in order once the watermark has passed them.

    Checks may come in any order within ``delay``; later ones are left out. A subject's
    checked seconds wait in the state store, an entry and a timer for a day of them, and go as the timers fire;
    so memory does not follow the length of a backlog, and neither do the calls to the store follow the checks.
    """
    fired = with_event_time(checks, delay, "checked_at").groupBy("subject").transformWithStateInPandas(
        statefulProcessor=_TimedWatch(), outputStructType="subject string, triggered_at timestamp", outputMode="append", timeMode="EventTime",
    )
    return fired.select(
        F.lit("schema_evolution").alias("trigger_type"), F.regexp_replace("subject", "-value$", "").alias("source_topic"), "triggered_at"
    )
