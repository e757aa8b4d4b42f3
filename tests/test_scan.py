import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from fieldscan.operators import rollup, scan
from fieldscan.sources import sinks
from fieldscan.streaming import routing as stream_routing
from fieldscan.streaming import scan as stream_scan

BASE = dt.datetime(2024, 1, 1)
MESSAGE = "msg_id string, topic string, key string, value string, event_time timestamp"
VALUE = json.dumps({"email": "a@b.com", "note": "plain"})


def message(i, seconds, topic="t", value=VALUE):
    return (str(i), topic, f"k{i}", value, BASE + dt.timedelta(seconds=seconds))


def test_interval_scan_against_all_pairs(spark):
    rng = random.Random(3)
    # A third of the messages sit in one topic and minute.
    times = [(rng.choice("ab"), rng.randrange(7200)) for _ in range(200)] + [("a", 3600 + rng.randrange(60)) for _ in range(100)]
    times += [("a", 0), ("a", 120), ("a", 121)]
    messages = [message(i, s, t) for i, (t, s) in enumerate(times)]
    trigs = [("manual", t, BASE + dt.timedelta(seconds=s)) for t, s in [("a", 120), ("a", 0), ("a", 3660), ("a", 3661), ("b", 3600), ("c", 60), ("b", 7300)]]
    want = sorted(
        (m[0], t[2]) for m in messages for t in trigs if m[1] == t[1] and t[2] - dt.timedelta(minutes=2) <= m[4] <= t[2]
    )
    t = spark.createDataFrame(trigs, "trigger_type string, source_topic string, triggered_at timestamp")
    for salts in (None, 1, 8):
        got = scan.interval_scan(t, spark.createDataFrame(messages, MESSAGE), salts=salts)
        assert sorted((r["msg_id"], r["triggered_at"]) for r in got.collect()) == want and want


def test_messages_in_reach_come_once_and_are_classified_before_they_meet_triggers(spark, tmp_path):
    """Before, a message was classified for each trigger that reaches it."""
    from workload import queries

    rng = random.Random(7)
    # Around 1970, where whole-number division turns; copies, and rows without a topic or a time.
    at = lambda s: dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s, microseconds=rng.choice([0, 1, 999_999]))
    messages = [(str(i), rng.choice("ab"), f"k{i}", VALUE, at(rng.randrange(-900, 900))) for i in range(300)]
    messages += messages[:20] + [("x", None, "k", VALUE, at(0)), ("y", "a", "k", VALUE, None)]
    trigs = [("manual", rng.choice("aab"), at(rng.randrange(-900, 900))) for _ in range(4)] * 2 + [("manual", "a", None)]
    m, t = spark.createDataFrame(messages, MESSAGE), spark.createDataFrame(trigs, "trigger_type string, source_topic string, triggered_at timestamp")
    reaches = lambda x, y: x[1] == y[1] and x[4] is not None and y[2] is not None and y[2] - dt.timedelta(minutes=2) <= x[4] <= y[2]
    want = sorted(x[0] for x in messages if any(reaches(x, y) for y in trigs))
    assert sorted(r["msg_id"] for r in scan.in_reach(t, m).collect()) == want and 10 < len(want) < 290
    each = scan.scan_results(scan.interval_scan(t, m), ["msg_id"], 2)
    once = scan.scan_results(scan.interval_scan(t, scan.scan_rows(scan.in_reach(t, m), ["msg_id"], 2)), ["msg_id"], 2)
    assert once.columns == each.columns and once.dtypes == each.dtypes
    assert sorted(map(repr, once.collect())) == sorted(map(repr, each.collect())) and each.count() > len(want)

    spark.range(40).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id) AS ts", "id % 5 AS user_id", "'click' AS event_type", "1.0 AS value", "'' AS props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    plan = queries._results(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Generate")


def test_results_latest_batch_and_retention(spark, tmp_path):
    messages = spark.createDataFrame([message(1, 30), message(2, 90, value='{"ssn":"1"}'), message(3, 4000), message(4, 30, "u")], MESSAGE)
    trigs = scan.all_triggers(scan.scheduled_triggers(messages), scan.scheduled_triggers(messages, 1))
    results = scan.scan_results(scan.interval_scan(trigs, messages), ["msg_id"], 2).cache()
    assert {(r["source_topic"], r["scanned_at"]) for r in results.collect()} >= {("t", BASE + dt.timedelta(minutes=1)), ("t", BASE + dt.timedelta(minutes=2))}
    best = [(r["source_topic"], r["field_path"], r["tag"], r["confidence"]) for r in rollup.latest_best(results).collect()]
    assert best == [("t", "email", "PII", 1.0), ("u", "email", "PII", 1.0)]
    assert {r["scanned_at"] for r in rollup.latest_batch(results).where("source_topic = 't'").collect()} == {BASE + dt.timedelta(seconds=4020)}
    scan.append_results(results, str(tmp_path / "results"))
    scan.append_results(results, str(tmp_path / "results"))
    read = scan.read_results(spark, str(tmp_path / "results"), "u", today="2024-01-07")
    assert read.count() == 2 * results.where("source_topic = 'u'").count()
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_topic" in plan
    assert scan.read_results(spark, str(tmp_path / "results"), today="2024-01-09").count() == 0
    new, old = rollup.split_new(results, spark.createDataFrame([("email", "PII")], "field_path string, tag string"))
    assert {r["tag"] for r in new.collect()} == {"GOVERNMENT_ID"} and {r["tag"] for r in old.collect()} == {"PII"}


def test_schema_changes_against_a_plain_replay(spark):
    rng = random.Random(11)
    checks = [(f"s{i % 3}-value", rng.randrange(1, 9), BASE + dt.timedelta(seconds=100 * i)) for i in range(200)]
    known, want = {}, []
    for subject, version, at in checks:
        if subject in known and version > known[subject]:
            want.append((subject[:2], at))
        known[subject] = max(version, known.get(subject, 0))
    df = spark.createDataFrame(checks, "subject string, version int, checked_at timestamp")
    got = [(r["source_topic"], r["triggered_at"]) for r in scan.schema_change_triggers(df).collect()]
    assert sorted(got) == sorted(want)


def test_manual_trigger(spark):
    row = scan.manual_trigger(spark, "t").first()
    assert (row["trigger_type"], row["source_topic"]) == ("manual", "t") and row["triggered_at"] is not None


# ---- streams: waves of files, one micro-batch each ----


@pytest.fixture
def wave(spark, tmp_path):
    """Write rows as the next file of a folder that a stream reads."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    return write


def run(rows, tmp_path, name="out"):
    stream_routing.start_sink(rows, str(tmp_path / name / "data"), str(tmp_path / name / "checkpoint")).awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(str(tmp_path / name / "data")).collect()


def stream(spark, tmp_path, name, schema):
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


def test_interval_join_waits_for_the_watermark_and_drops_late_rows(spark, wave, tmp_path):
    trig = "trigger_type string, source_topic string, triggered_at timestamp"

    def joined():
        t = stream_scan.with_event_time(stream(spark, tmp_path, "t", trig), column="triggered_at")
        rows = stream_scan.interval_scan_stream(t, stream(spark, tmp_path, "m", MESSAGE))
        return sorted((r["msg_id"], r["triggered_at"]) for r in run(rows.select("msg_id", "triggered_at"), tmp_path))

    at = BASE + dt.timedelta(seconds=300)
    wave("m", [message(1, 180), message(2, 179), message(3, 300), message(4, 301)], MESSAGE)
    wave("t", [("manual", "t", at)], trig)
    assert joined() == [("1", at), ("3", at)]
    # Both clocks move on; then a message of the old interval comes too late.
    wave("m", [message(5, 5000)], MESSAGE)
    wave("t", [("manual", "t", BASE + dt.timedelta(seconds=5000))], trig)
    joined()
    wave("m", [message(6, 200)], MESSAGE)
    assert [m for m, _ in joined()] == ["1", "3", "5"]


def test_tumbling_triggers_leave_the_open_window_out(spark, wave, tmp_path):
    rows = [message(i, s) for i, s in enumerate([10, 20, 3700, 7300, 7400])]
    wave("m", rows, MESSAGE)
    batch = scan.scheduled_triggers(spark.createDataFrame(rows, MESSAGE)).collect()
    got = run(stream_scan.scheduled_trigger_stream(stream(spark, tmp_path, "m", MESSAGE)), tmp_path)
    assert sorted(r["triggered_at"] for r in got) == sorted(r["triggered_at"] for r in batch)[:2]


def test_schema_watch_keeps_state_between_runs(spark, wave, tmp_path):
    schema = "subject string, version int, checked_at timestamp"
    at = lambda s: BASE + dt.timedelta(seconds=s)

    def fired():
        rows = run(stream_scan.schema_change_stream(stream(spark, tmp_path, "c", schema)), tmp_path)
        return sorted((r["source_topic"], r["triggered_at"]) for r in rows)

    # A rise within the minute is not looked at; it fires at the next check.
    wave("c", [("a-value", 3, at(0)), ("a-value", 4, at(30)), ("b-value", 1, at(0))], schema)
    assert fired() == []
    wave("c", [("a-value", 4, at(70)), ("b-value", 1, at(100)), ("a-value", 2, at(200)), ("a-value", 4, at(300))], schema)
    assert fired() == [("a", at(70))]
    wave("c", [("b-value", 2, at(400)), ("a-value", 5, at(500))], schema)
    assert fired() == [("a", at(70)), ("a", at(500)), ("b", at(400))]


class _Calls:
    """State of one subject in a dict, with its timers; calls are counted."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, set(), 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return type("V", (), {"exists": lambda _: "seen" in self.rows, "get": lambda _: self.rows["seen"], "update": lambda _, v: self.rows.update(seen=v)})()

    def _counted(self, what):
        self.calls += 1
        return what

    def containsKey(self, k):
        return self._counted(k in self.rows)

    def getValue(self, k):
        return self._counted(self.rows[k])

    def updateValue(self, k, v):
        self._counted(self.rows.update({k: v}))

    def removeKey(self, k):
        self._counted(self.rows.pop(k))

    def registerTimer(self, at):
        self._counted(self.timers.add(at))

    def deleteTimer(self, at):
        self._counted(self.timers.remove(at))


def test_timed_watch_asks_the_store_by_the_day_and_fires_like_a_plain_walk():
    import pandas as pd

    rng, handle, watch = random.Random(5), _Calls(), stream_scan._TimedWatch()
    watch.init(handle)
    checks = [(rng.randrange(200_000), rng.randrange(40)) for _ in range(20_000)]
    clock = lambda s: type("T", (), {"getCurrentWatermarkInMs": lambda _: 1000 * s})()
    frame = lambda rows: pd.DataFrame({"checked_at": [BASE + dt.timedelta(seconds=s, milliseconds=7) for s, _ in rows], "version": [v for _, v in rows]})
    start, got, done = int(BASE.replace(tzinfo=dt.timezone.utc).timestamp()), [], 0
    for upto in (0, 100_000, 150_000):
        now = clock(start + upto - 1) if upto else clock(0)
        part = checks[done : done + 8_000]
        done += len(part)
        list(watch.handleInputRows(("s",), iter([frame(part[:3_000]), frame(part[3_000:])]), now))
        for at in sorted(t for t in handle.timers if t <= now.getCurrentWatermarkInMs()):
            handle.timers.remove(at)
            for out in watch.handleExpiredTimer(("s",), now, type("E", (), {"getExpiryTimeInMs": lambda _: at})()):
                got += [round((t - pd.Timestamp(BASE)).total_seconds()) for t in out["triggered_at"]]
    # What came after its time had been passed is left out, and so is what has not been passed.
    came = checks[:8_000] + [c for c in checks[8_000:16_000] if c[0] >= 100_000] + [c for c in checks[16_000:] if c[0] >= 150_000]
    known, last, want = None, None, []
    top = {}
    for s, v in came:
        top[s] = max(v, top.get(s, 0))
    for s in sorted(x for x in top if x < 150_000):
        if last is not None and s - last < stream_scan.CHECK_SECONDS:
            continue
        if known is not None and top[s] > known:
            want.append(s)
        known, last = max(top[s], known or 0), s
    assert got == want and want and handle.calls < 100


def test_timed_watch_stream_keeps_state_between_runs(spark, wave, tmp_path):
    schema = "subject string, version int, checked_at timestamp"
    at = lambda s: BASE + dt.timedelta(seconds=s)

    def fired():
        rows = run(stream_scan.schema_watch_stream(stream(spark, tmp_path, "c", schema)), tmp_path)
        return sorted((r["source_topic"], r["triggered_at"]) for r in rows)

    wave("c", [("a-value", 3, at(0)), ("a-value", 4, at(30)), ("a-value", 4, at(70)), ("b-value", 1, at(90_000))], schema)
    assert fired() == [("a", at(70))]
    wave("c", [("a-value", 5, at(90_300)), ("b-value", 2, at(90_200)), ("b-value", 3, at(180_000))], schema)
    assert fired() == [("a", at(70)), ("a", at(90_300)), ("b", at(90_200))]


def test_routing_stream_is_not_doubled_by_a_replay(spark, wave, tmp_path):
    out, seen = str(tmp_path / "out"), []
    wave("m", [message(1, 1), message(2, 2, value='{"n":1}'), message(3, 3, value="broken"), message(4, 4, value="")], MESSAGE)

    def start(check, fail=False):
        def also(routed, batch_id):
            seen.append(batch_id)
            if fail:
                raise RuntimeError("downstream is down")

        return stream_routing.start_routing(stream(spark, tmp_path, "m", MESSAGE), ["msg_id"], out, str(tmp_path / check), 2, also=also)

    with pytest.raises(Exception):
        start("c", fail=True).awaitTermination()
    start("c").awaitTermination()
    assert seen == [0, 0]
    routed = {r["sink"]: r["n"] for r in spark.read.parquet(f"{out}/routed").groupBy("sink").agg(F.count("*").alias("n")).collect()}
    assert routed == {"classified-messages": 1, "classified-safe": 1}
    assert spark.read.parquet(f"{out}/audit").count() == 4


def test_detection_and_alert_streams_match_batch(spark, wave, tmp_path):
    rows = [message(1, 1, value='{"ssn":"1","email":"e"}'), message(2, 2, value='{"password":"p"}')]
    wave("m", rows, MESSAGE)
    got = run(stream_routing.alert_stream(stream(spark, tmp_path, "m", MESSAGE), ["msg_id"], 2), tmp_path)
    assert sorted((r["msg_id"], r["tag"], r["confidence"]) for r in got) == [("1", "GOVERNMENT_ID", 0.92), ("2", "CREDENTIALS", 0.95)]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "store")
    sinks.write_snapshot(spark.range(3), root, 1)
    sinks.write_snapshot(sinks.read_snapshot(spark, root, 1).where("id > 0"), root, 2)
    assert sinks.read_snapshot(spark, root, 2).count() == 2 and sinks.read_snapshot(spark, root, 1).count() == 3


def test_a_partial_batch_goes_while_the_source_is_stalled(spark, wave, tmp_path):
    """Nothing comes after the first seven messages, and still they go."""
    import time

    wave("m", [message(i, i) for i in range(7)], MESSAGE)
    rows = stream_routing.idle_batches(stream(spark, tmp_path, "m", MESSAGE), F.lit(0))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    running = rows.writeStream.format("memory").queryName("flushed").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()

    def flushed(n):
        for _ in range(120):
            got = spark.sql("SELECT batch, reason, count(*) AS n FROM flushed GROUP BY ALL ORDER BY batch").collect()
            if sum(r["n"] for r in got) >= n:
                return [tuple(r) for r in got]
            time.sleep(0.5)
        raise AssertionError(got)

    try:
        assert flushed(7) == [(0, "idle", 7)]
        wave("m", [message(100 + i, i % 50) for i in range(60)], MESSAGE)
        assert flushed(67) == [(0, "idle", 7), (1, "full", 50), (2, "idle", 10)]
    finally:
        running.stop()
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_all_that_a_slow_stream_holds_back_is_waited_for(spark, tmp_path, monkeypatch):
    """Before, what was there after sixty looks was the result; here they are over at once."""
    from pyspark.sql.streaming.query import StreamingQuery
    from workload.queries import QUERIES

    rows = spark.range(430).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id) AS ts", "id % 5 AS user_id", "'click' AS event_type", "1.0 AS value", "'' AS props")
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    wait = StreamingQuery.awaitTermination
    monkeypatch.setattr(StreamingQuery, "awaitTermination", lambda self, timeout=None: wait(self, 0.01))
    got = QUERIES["stream_idle_flush"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((s, b, "idle" if b else "full", 50 if b == 0 else 4 - (s > 5)) for s in range(8) for b in (0, 1))


def test_a_stream_that_ends_or_stalls_is_no_result():
    class Running:
        def __init__(self, ends):
            self.ends, self.batch = ends, 0

        def awaitTermination(self, _):
            self.batch += 1
            return self.ends

        @property
        def lastProgress(self):
            return {"batchId": self.batch, "numInputRows": 7 if self.batch < 300 else 0}

    stalls = Running(False)
    for running, arrived, why in ((Running(True), 5, "ended"), (stalls, 5, "stalled"), (Running(False), 8, "8 rows of 7")):
        with pytest.raises(stream_routing.Unfinished, match=why):
            stream_routing.await_rows(running, lambda: arrived, 7)
    # It goes on as long as something is read, and ends with the last row.
    assert stalls.batch >= 300 + stream_routing.STALLED_BATCHES - 1
    looks = iter([0, 3, 3, 7])
    stream_routing.await_rows(Running(False), lambda: next(looks), 7)


def test_batches_of_a_slot_go_on_across_frames_and_micro_batches():
    import pandas as pd

    class Handle:
        def __init__(self):
            self.state, self.timers = {}, set()

        def getListState(self, *_):
            return type("L", (), {"exists": lambda _: bool(self.state.get("w")), "get": lambda _: iter(self.state["w"]), "put": lambda _, v: self.state.update(w=v), "clear": lambda _: self.state.update(w=[])})()

        def getValueState(self, *_):
            return type("V", (), {"exists": lambda _: "n" in self.state, "get": lambda _: self.state["n"], "update": lambda _, v: self.state.update(n=v)})()

        def listTimers(self):
            return list(self.timers)

        def deleteTimer(self, at):
            self.timers.remove(at)

        def registerTimer(self, at):
            self.timers.add(at)

    handle, pending = Handle(), stream_routing._Pending(50, 1000)
    pending.init(handle)
    now = type("T", (), {"getCurrentProcessingTimeInMs": lambda _: 0})()
    frame = lambda a, b: pd.DataFrame({"msg_id": [str(i) for i in range(a, b)], "topic": None, "key": "k", "value": "v", "event_time": pd.to_datetime(range(a, b), unit="s").where(pd.Series(range(a, b)) % 7 > 0)})
    out = list(pending.handleInputRows((3,), iter([frame(0, 70), frame(70, 130), frame(130, 340)]), now))
    out += list(pending.handleInputRows((3,), iter([frame(340, 345)]), now))
    out += list(pending.handleExpiredTimer((3,), now, None))
    out += list(pending.handleInputRows((3,), iter([frame(345, 400)]), now))
    got = pd.concat(out)
    assert got["msg_id"].tolist() == [str(i) for i in range(395)] and set(got["slot"]) == {3} and len(handle.state["w"]) == 5 and handle.timers
    assert got["batch"].tolist() == [i // 50 for i in range(345)] + [7] * 50
    assert got["reason"].tolist() == ["full"] * 300 + ["idle"] * 45 + ["full"] * 50
    assert got["event_time"].isna().tolist() == [i % 7 == 0 for i in range(395)]
    # As many frames leave as came, not one for each batch.
    assert len(out) == 5


def test_only_finished_batches_are_read(spark, wave, tmp_path):
    out = str(tmp_path / "out")
    wave("m", [message(1, 1), message(2, 2, value='{"n":1}')], MESSAGE)

    def start(between=None):
        return stream_routing.start_routing(stream(spark, tmp_path, "m", MESSAGE), ["msg_id"], out, str(tmp_path / "c"), 2, between=between)

    def down(*_):
        raise RuntimeError("down")

    with pytest.raises(Exception):
        start(down).awaitTermination()
    assert spark.read.parquet(f"{out}/routed").count() == 2
    with pytest.raises(FileNotFoundError):
        stream_routing.committed(spark, out, "routed")
    start().awaitTermination()
    assert stream_routing.committed(spark, out, "routed").count() == stream_routing.committed(spark, out, "audit").count() == 2


def test_a_replay_does_not_classify_again(spark, wave, tmp_path):
    """Before, every replay worked all of its batch out once more."""
    out = str(tmp_path / "out")
    wave("m", [message(1, 1), message(2, 2, value='{"ssn":"1"}'), message(3, 3, value="broken"), message(4, 4, value=None)], MESSAGE)

    def start(check, fails=None, layer=2):
        def stop(*_):
            raise RuntimeError("down")

        return stream_routing.start_routing(stream(spark, tmp_path, "m", MESSAGE), ["msg_id"], out, str(tmp_path / check), layer, **({fails: stop} if fails else {})).awaitTermination()

    # Sent rows hold the time at which their message was classified.
    sent = lambda: sorted(map(tuple, spark.read.parquet(f"{out}/routed").collect()))
    with pytest.raises(Exception):
        start("c", "between")
    first = sent()
    with pytest.raises(Exception):
        start("c", "also")
    assert sent() == first
    with pytest.raises(Exception):
        start("c", "also", 1)
    assert sent() != first
    start("c")
    assert sent() == first and spark.read.parquet(f"{out}/audit").count() == 4
    # What another query of the same path left is none of its business.
    start("d")
    assert len(sent()) == len(first) and sent() != first
    kept = [f.name for d in (tmp_path / "out" / "classified").iterdir() for f in d.iterdir()]
    assert kept == ["000000000000"], "only of the settings that never came to an end"


def test_a_producer_that_starts_anew_adds_no_trigger_twice(spark, wave, tmp_path):
    schema = "topic string, requested_at timestamp"
    at = lambda s: f"2024-01-0{1 + s % 2} 00:00:{s:02d}"
    rows = [("t", at(1)), ("t", at(1)), ("t", at(2)), ("u", at(1))]
    parsed = lambda rs: spark.createDataFrame(rs, "topic string, at string").selectExpr("topic", "cast(at AS timestamp) AS requested_at").collect()
    wave("r", parsed(rows), schema)
    log = str(tmp_path / "log")
    for attempt in ("a", "a", "b"):
        triggers = stream_scan.manual_trigger_stream(stream(spark, tmp_path, "r", schema))
        stream_scan.start_triggers(triggers, log, str(tmp_path / attempt), "manual").awaitTermination()
    wave("r", parsed([("u", at(3)), ("u", at(1))]), schema)
    stream_scan.start_triggers(stream_scan.manual_trigger_stream(stream(spark, tmp_path, "r", schema)), log, str(tmp_path / "b"), "manual").awaitTermination()
    got = sorted((r["trigger_type"], r["source_topic"], str(r["triggered_at"])) for r in stream_scan.trigger_log(spark, log).collect())
    assert got == sorted(("manual", t, at(s)) for t, s in [("t", 1), ("t", 2), ("u", 1), ("u", 3)])


def test_tables_are_dealt_over_more_tasks_as_they_grow(spark, tmp_path):
    from workload.inputs import parts_of, spread, stream_of

    small, large = spark.range(1000), spark.range(10_000_000)
    cores = spark.sparkContext.defaultParallelism
    assert parts_of(small) == cores and parts_of(large) > 4 * cores and spread(large).rdd.getNumPartitions() == parts_of(large)
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    found = []
    rows = stream_of(spark, str(tmp_path), "t")
    rows.writeStream.foreachBatch(lambda b, _: found.append((b.rdd.getNumPartitions(), b.count()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert found == [(cores, 100)]
