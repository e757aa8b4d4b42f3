"""Continuous routing, recommendations, alerts and the live detection view."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldscan.operators.rollup import alerts
from fieldscan.operators.routing import audit_rows, envelopes, route
from fieldscan.plans.classify import CLASSIFIER_VERSION, classify_fields
from fieldscan.sources.manifest import Conflict, listed, publish, remove, text_of
from fieldscan.sources.sinks import write_batch

# Messages of a batch, and how long a partial one waits.
BATCH_SIZE, IDLE_MS = 50, 1000
STALLED_BATCHES = 100


def detection_view(messages: DataFrame, ids: list[str], max_layer: int = 3, **options) -> DataFrame:
    """Every detection of every message as it arrives; stateless, append mode."""
    rows = classify_fields(messages, [*ids, "event_time"], max_layer, **options)
    return rows.withColumn("confidence", F.round("score", 2))


def alert_stream(messages: DataFrame, ids: list[str], max_layer: int = 3, **options) -> DataFrame:
    return alerts(detection_view(messages, ids, max_layer, **options))


def start_routing(
    messages: DataFrame,
    ids: list[str],
    path: str,
    checkpoint: str,
    max_layer: int = 3,
    every: str | None = None,
    also: Callable[[DataFrame, int], None] | None = None,
    between: Callable[[DataFrame, int], None] | None = None,
    **options,
) -> StreamingQuery:
    """Route each micro-batch to ``path/routed`` by sink and audit it to ``path/audit``.

    A batch counts as done only when both writes (and ``also``, for instance an
    upsert of recommendations, or ``between``, called after the first write) succeeded: then it is entered in a commit log, and
    ``committed`` reads what is entered there. A replay overwrites what it wrote. What takes
    long, its classification, is kept under ``path/classified`` until then, so a replay with the same
    settings only writes. With ``every`` (say ``1 second``) the query runs on; without, it takes what is there
    and stops.
    """
    spark = messages.sparkSession
    settings = hashlib.sha256(repr((CLASSIFIER_VERSION, ids, max_layer, sorted(options.items()))).encode()).hexdigest()[:16]

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Another query into the same path has other batches under the same numbers.
        query = json.loads(text_of(spark, f"{checkpoint}/metadata"))["id"]
        kept = f"{path}/classified/{query}-{settings}/{batch_id:012d}"
        routed = _classified(spark, route(batch, ids, max_layer, **options), kept)
        write_batch(envelopes(routed).withColumnRenamed("topic", "sink"), f"{path}/routed", batch_id, ["sink"])
        if between:
            between(routed, batch_id)
        write_batch(audit_rows(routed, ids), f"{path}/audit", batch_id)
        if also:
            also(routed, batch_id)
        try:
            publish(spark, f"{path}/commits/{batch_id:012d}.json", json.dumps({"batch": batch_id}))
        except Conflict:
            pass  # entered by the run that this one replays
        remove(spark, kept)

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _classified(spark: SparkSession, routed: DataFrame, kept: str) -> DataFrame:
    """``routed`` as written to the folder ``kept``, worked out only if it is not there in full."""
    if "done.json" not in listed(spark, kept):
        routed.write.mode("overwrite").parquet(f"{kept}/rows")
        publish(spark, f"{kept}/done.json", "{}")
    return routed.sparkSession.read.schema(routed.schema).parquet(f"{kept}/rows")


def committed(spark: SparkSession, path: str, what: str) -> DataFrame:
    """The rows ``what`` ("routed" or "audit") of all batches whose every write succeeded.

    A batch that failed between its writes has rows in one folder only; they are not
    read until its replay has finished.
    """
    batches = [n for n in listed(spark, f"{path}/commits") if n.endswith(".json")]
    if not batches:
        raise FileNotFoundError(f"no batch of {path} is finished")
    folders = [f"{path}/{what}/batch={int(n[:-5])}" for n in sorted(batches)]
    return spark.read.option("basePath", f"{path}/{what}").parquet(*folders).drop("batch")


def start_sink(rows: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append a stream's rows to parquet files."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.outputMode("append").start()


class Unfinished(RuntimeError):
    """A stream has not brought all its rows and is not going to."""


def await_rows(running: StreamingQuery, arrived: Callable[[], int], total: int, poll: float = 1) -> None:
    """Wait until ``arrived()`` has counted ``total`` rows, however long that takes.

    What a stream has written before is no result: if it ends, if ``STALLED_BATCHES`` of its batches in
    a row have neither read nor written anything, or if there are too many rows, this raises.
    """
    before, since = -1, None
    while (n := arrived()) != total:
        if n > total:
            raise Unfinished(f"{n} rows of {total}")
        if running.awaitTermination(poll) and arrived() != total:
            raise Unfinished(f"the stream ended after {arrived()} rows of {total}")
        progress = running.lastProgress
        if progress is None:
            continue
        if since is None or n != before or progress["numInputRows"]:
            before, since = n, progress["batchId"]
        if progress["batchId"] - since >= STALLED_BATCHES:
            raise Unfinished(f"the stream has stalled after {n} rows of {total}")


class _Pending(StatefulProcessor):
    """Per slot: the messages that wait for their batch to fill, and a timer that lets them go."""

    def __init__(self, size: int, idle_ms: int):
        self._size, self._idle_ms = size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "msg_id string, topic string, key string, value string, event_time timestamp")
        self._sent = handle.getValueState("sent", "n long")

    def _batches(self, key, out: pd.DataFrame, reason: str) -> pd.DataFrame:
        """Rows with the numbers of their batches, which go on where the last one ended."""
        number = self._sent.get()[0] if self._sent.exists() else 0
        self._sent.update((number - (-len(out) // self._size),))
        return out.assign(slot=key[0], batch=number + np.arange(len(out)) // self._size, reason=reason)[["slot", "batch", "reason", *_MESSAGE]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self._waiting.get()) if self._waiting.exists() else []
        for frame in rows:
            frame = frame[_MESSAGE]
            if held:
                frame = pd.concat([pd.DataFrame(held, columns=_MESSAGE).astype(frame.dtypes), frame])
            # All the full batches of a frame go as one: a message at a time takes as long as everything else.
            full = len(frame) // self._size * self._size
            if full:
                yield self._batches(key, frame.iloc[:full], "full")
            held = list(frame.iloc[full:].itertuples(index=False, name=None))
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if held:
            self._waiting.put(held)
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._idle_ms)
        else:
            self._waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self._waiting.get()) if self._waiting.exists() else []
        self._waiting.clear()
        if held:
            yield self._batches(key, pd.DataFrame(held, columns=_MESSAGE), "idle")

    def close(self) -> None:
        pass


_MESSAGE = ["msg_id", "topic", "key", "value", "event_time"]


def idle_batches(messages: DataFrame, slot: Column, size: int = BATCH_SIZE, idle_ms: int = IDLE_MS) -> DataFrame:
    """Messages in batches of ``size`` per slot; what is left of one goes once nothing has come for ``idle_ms``.

    Rows are the messages with ``slot``, the number of their ``batch`` and the ``reason`` it
    went ("full" or "idle"). Slots are dealt over tasks and hold less than a batch each.
    """
    rows = messages.select(slot.cast("long").alias("slot"), "msg_id", "topic", "key", F.col("value").cast("string").alias("value"), "event_time")
    return rows.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=_Pending(size, idle_ms),
        outputStructType="slot long, batch long, reason string, msg_id string, topic string, key string, value string, event_time timestamp",
        outputMode="append", timeMode="ProcessingTime",
    )
