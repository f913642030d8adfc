"""Streams end with the rows of their batch forms, and replays leave no duplicates."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import connections as conns, ingest, series, state
from tidemark.schemas import CONNECTION_EVENTS, CONNECTIONS, DEVICES, READINGS
from tidemark.sources import tables
from tidemark.sources.testdata import TestTables
from tidemark.streaming import handshake, jobs, sinks
from tidemark.streaming.log import BatchTable

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return TestTables(spark, FOLDER)


@pytest.fixture(scope="module")
def message_files(t, tmp_path_factory):
    """The messages as several files, in order of arrival."""
    path = str(tmp_path_factory.mktemp("in") / "messages")
    t.messages.repartitionByRange(4, "msg_id").write.json(path)
    return path


def rows(frame):
    return sorted(map(tuple, frame.select(sorted(frame.columns)).collect()), key=repr)


def test_batches_equal_one_pass(spark, t, message_files, tmp_path):
    store = jobs.IngestStore(spark, str(tmp_path))
    work = jobs.ingest_batch(store, lambda: (t.devices, t.connections))
    seen = {}

    def watched(batch, batch_id):
        seen[batch_id] = [r.msg_id for r in batch.select("msg_id").collect()]
        work(batch, batch_id)

    stream = tables.stream_messages(spark, message_files, max_files=1)
    jobs.run(stream, watched, f"{tmp_path}/checkpoint", trigger=None).awaitTermination()
    assert len(store.readings.of_source("device")._complete("batches/batch_id")) == 4

    outcomes = jobs.decided(tables.read_messages(spark, message_files), t.devices, t.connections, "device")
    readings = ingest.new_readings(outcomes)
    latest = rows(state.current_values(ingest.new_values(outcomes)))
    live = rows(series.live_series(readings))
    assert rows(store.readings.read().drop("day")) == rows(readings)
    assert rows(store.current_values()) == latest
    assert rows(store.live_series()) == live
    store.compact()
    assert rows(store.current_values()) == latest
    assert rows(store.live_series()) == live
    assert store.replies.read().count() == ingest.replies(outcomes, t.connections, datetime(2024, 2, 1)).count()
    assert store.outbox.read().count() > store.commands.read().count() > 0

    # The same batch again, and a folder of a batch that did not finish.
    batch = tables.read_messages(spark, message_files).where(F.col("msg_id").isin(seen[0]))
    before = rows(store.readings.read())
    work(batch, 0)
    assert rows(store.readings.read()) == before
    spark.range(3).write.parquet(f"{tmp_path}/readings/sources/source=device/batches/batch_id=9")
    (tmp_path / "readings/sources/source=device/batches/batch_id=9/_SUCCESS").unlink()
    assert rows(store.readings.read()) == before
    stored_value = spark.read.parquet(f"{tmp_path}/readings/sources/source=device/batches/batch_id=0")
    assert "day" in stored_value.columns


def test_dashboard_messages(spark, t, tmp_path):
    owned = ingest.authenticate(t.messages, tables.registry(t.devices)).where("accepted").select("msg_id", "ts", "user_id", "raw")
    store = jobs.IngestStore(spark, str(tmp_path))
    jobs.ingest_batch(store, lambda: (t.devices, t.connections), "dashboard")(owned, 0)
    replies = {r.status: r["count"] for r in store.replies.read().groupBy("status").count().collect()}
    assert set(replies) == {"ack", "error"}
    assert store.commands.read().count() == replies["ack"]


def test_values_for_no_registered_device_are_kept(spark, tmp_path):
    """A dashboard may name any device; what is acknowledged is stored."""
    raws = ['{"device_id":"abc","var":"a","val":1}', '{"device_id":"abc","var":"a","val":null}', '{"device_id":9,"var":"a","val":2}']
    batch = spark.createDataFrame([(i, datetime(2024, 1, 1), 1, r) for i, r in enumerate(raws)],
                                  "msg_id long, ts timestamp_ntz, user_id long, raw string")
    store = jobs.IngestStore(spark, str(tmp_path))
    nothing = spark.createDataFrame([], DEVICES), spark.createDataFrame([], CONNECTIONS)
    jobs.ingest_batch(store, lambda: nothing, "dashboard")(batch, 0)
    assert [(r.data_id, r.device_text, r.value) for r in store.strays.read().collect()] == [(1, "abc", "1")]
    assert [r.data_id for r in store.readings.read().collect()] == [3]
    assert {(r.msg_id, r.device_id, r.val) for r in store.replies.read().collect()} == {
        (0, "abc", "1"), (1, "abc", None), (2, "9", "2")}


def test_sender_connection_is_skipped(spark, tmp_path):
    devices = spark.createDataFrame([(1, 1, "one", "a", "k", None)], DEVICES)
    connections = spark.createDataFrame(
        [], "conn_key long, conn_type string, device_id long, user_id long, slug string, opened_at timestamp_ntz, "
            "auth_at timestamp_ntz, closed_at timestamp_ntz")
    batch = spark.createDataFrame([(1, datetime(2024, 1, 1), "k", '{"var":"a","val":25.5}', 77)],
                                  "msg_id long, ts timestamp_ntz, secret_key string, raw string, conn_key long")
    store = jobs.IngestStore(spark, str(tmp_path))
    jobs.ingest_batch(store, lambda: (devices, connections))(batch, 0)
    records = {r.audience: r for r in store.outbox.read().collect()}
    assert records["devices"].skip_conn_key == 77 and records["user:1"].skip_conn_key is None
    assert '"val":25.5' in records["user:1"].payload
    frame = store.replies.read().first().frame
    assert frame == ('{"status":"ack","type":"dataReceived","sensor_type":"a","value":25.5,'
                     '"timestamp":"2024-01-01T00:00:00.000Z","message":"Data berhasil diterima"}')


def test_null_value_is_answered_but_not_stored(spark, tmp_path):
    devices = spark.createDataFrame([(5, 1, "five", "a", "k", "p")], DEVICES)
    connections = spark.createDataFrame(
        [], "conn_key long, conn_type string, device_id long, user_id long, slug string, opened_at timestamp_ntz, "
            "auth_at timestamp_ntz, closed_at timestamp_ntz")
    at = datetime(2024, 1, 1)
    raws = ['{"var":"a","val":null,"value":3}', '{"device_id":0,"var":"a","val":1}', '{"device_id":"","var":"a","val":1}',
            '{"device_id":5,"var":"led","val":true}', 'null', '{"var":"","sensor_type":"g","val":1}']
    batch = spark.createDataFrame([(i, at, "k", r, None) for i, r in enumerate(raws)],
                                  "msg_id long, ts timestamp_ntz, secret_key string, raw string, conn_key long")
    store = jobs.IngestStore(spark, str(tmp_path))
    jobs.ingest_batch(store, lambda: (devices, connections))(batch, 0)
    assert [r.data_id for r in store.readings.read().orderBy("data_id").collect()] == [3, 4]
    assert sorted((r.msg_id, r.status) for r in store.replies.read().collect()) == [
        (0, "ack"), (1, "error"), (2, "ack"), (3, "ack")]
    assert sorted((r.update_id, r.audience) for r in store.outbox.read().collect() if r.update_id in (0, 3)) == [
        (0, "devices"), (0, "slug:p"), (0, "user:1"), (3, "slug:p"), (3, "user:1")]


def test_current_value_state_over_batches(spark, t, tmp_path):
    source = str(tmp_path / "readings")
    t.readings.repartitionByRange(3, "data_id").write.parquet(source)
    table = BatchTable(spark, str(tmp_path / "values"), jobs.READING)
    jobs.current_value_job(tables.stream_table(spark, source, "sensor_data", 1), table, str(tmp_path / "c"),
                           trigger=None).awaitTermination()
    assert len(table._complete("batches/batch_id")) >= 3
    assert rows(state.current_values(table.read())) == rows(state.current_values(t.readings))


def test_connection_events_over_batches(spark, t, tmp_path):
    source = str(tmp_path / "events")
    events = tables.connection_events(t.connections)
    events.repartition(3).write.parquet(source)
    table = BatchTable(spark, str(tmp_path / "steps"), jobs.STEPS)
    jobs.connection_job(tables.stream_table(spark, source, "connection_events", 1), table, str(tmp_path / "c"),
                        trigger=None).awaitTermination()
    table.compact(conns.reduce_connection_steps)
    got = conns.connection_state(conns.reduce_connection_steps(table.read()))
    assert rows(got) == rows(conns.connection_state(conns.connection_steps(events)))


def test_delete_job(spark, t, tmp_path):
    source = str(tmp_path / "requests")
    requests = t.delete_requests.withColumn("ts", F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz"))
    requests.repartitionByRange(3, "request_id").write.parquet(source)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(source)
    deleted = BatchTable(spark, str(tmp_path / "deleted"), jobs.DELETED)
    closes = BatchTable(spark, str(tmp_path / "closes"), jobs.CLOSES)
    jobs.delete_job(stream, lambda: t.devices, lambda: t.connections, deleted, closes, str(tmp_path / "c"),
                    trigger=None).awaitTermination()
    want = conns.deleted_ids(conns.delete_results(t.delete_requests, t.devices, "device_id"), "device_id")
    assert rows(deleted.read().select("device_id")) == rows(want)
    closing = conns.close_events(t.connections, want, datetime(2024, 2, 1))
    assert rows(closes.read().select("conn_key")) == rows(closing.select("conn_key"))


def test_deletes_revoke_keys_and_replay(spark, t, tmp_path):
    """Devices, connections and keys go together, and a repeated batch changes nothing."""
    requests = t.delete_requests.withColumn("ts", F.lit(datetime(2024, 2, 1)).cast("timestamp_ntz"))
    deleted, closes, revoked = (BatchTable(spark, str(tmp_path / n), s) for n, s in (
        ("deleted", jobs.DELETED), ("closes", jobs.CLOSES), ("revoked", jobs.REVOKED)))
    work = jobs.delete_batch(lambda: t.devices, lambda: t.connections, deleted, closes, revoked)
    batches = [requests.where(F.col("request_id") % 3 == i) for i in range(3)]
    for i, batch in enumerate(batches):
        work(batch, i)
    before = [rows(table.read()) for table in (deleted, closes, revoked)]
    for i in (1, 2):
        work(batches[i], i)
    assert [rows(table.read()) for table in (deleted, closes, revoked)] == before and all(before)
    want = conns.deleted_ids(conns.delete_results(requests, t.devices, "device_id"), "device_id")
    assert rows(deleted.read().select("device_id")) == rows(want)
    assert rows(revoked.read()) == rows(conns.revoked_keys(tables.registry(t.devices), want).select("device_id", "secret_key"))
    work(requests.limit(0), 3)
    assert rows(deleted.read()) == before[0]


def test_history_sink(spark, t, message_files, tmp_path):
    """Several batches, a restart, files nobody sees, and retention."""
    path, checkpoint = str(tmp_path / "history"), str(tmp_path / "c")
    stream = lambda: tables.stream_messages(spark, message_files, max_files=1)
    for _ in range(2):  # the second run finds nothing new
        jobs.history_job(stream(), t.devices, path, checkpoint, trigger=None).awaitTermination()
    want = rows(ingest.new_readings(jobs.decisions(tables.read_messages(spark, message_files), t.devices, "device")))
    assert rows(jobs.read_history(spark, path).drop("day")) == want
    assert jobs.sweep_history(spark, path, 0) == 0
    day = next((tmp_path / "history").glob("day=*"))
    (day / "part-of-a-failed-attempt.parquet").write_bytes(b"unfinished")
    assert rows(jobs.read_history(spark, path).drop("day")) == want
    assert jobs.sweep_history(spark, path) == 0 and jobs.sweep_history(spark, path, 0) == 1
    spark.conf.set("spark.sql.streaming.fileSink.log.compactInterval", "2")
    try:
        jobs.history_job(stream(), t.devices, str(tmp_path / "short"), str(tmp_path / "c2"), trigger=None,
                         retention="1ms").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.fileSink.log.compactInterval")
    kept = rows(jobs.read_history(spark, str(tmp_path / "short")).drop("day"))
    assert len(kept) < len(want) and jobs.sweep_history(spark, str(tmp_path / "short"), 0) > 0
    assert rows(jobs.read_history(spark, str(tmp_path / "short")).drop("day")) == kept


def test_clock_rows_leave_no_state(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    source, schema = str(tmp_path / "events"), "conn_key long, ts timestamp, event string"
    events = [(1, at(0), "open"), (1, at(1), "good"), (2, at(0), "open"), (3, at(1), "bad"), (-1, datetime(2030, 1, 1), "clock")]
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(source)
    run = (handshake.handshake_verdict_stream(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet")
           .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    run.awaitTermination()
    assert {(r.conn_key, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, "accepted"), (2, "timeout")}
    assert spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "c")).count() == 0


def test_exports_keep_times_and_empty_texts(spark, tmp_path):
    at = datetime(2024, 1, 1, 0, 0, 0, 123456)
    values = ["", None, "a", '"', "x,y", "null"]
    export = spark.createDataFrame([(1, at + timedelta(microseconds=i), "s", v, i) for i, v in enumerate(values)],
                                   "device_id long, ts timestamp_ntz, sensor_type string, value string, data_id long")
    sinks.write_exports(export, str(tmp_path / "all"), buckets=2)
    got = sorted(sinks.read_exports(spark, str(tmp_path / "all")).collect(), key=lambda r: r.position)
    assert [(r.position, r.value, r.ts.microsecond) for r in got] == [
        (i + 1, values[5 - i], 123456 + 5 - i) for i in range(6)]


def test_handshake_timers(spark, t, tmp_path):
    """Verdicts emitted by timers equal the batch verdicts; a late opening moves the clock past them all."""
    attempts = conns.auth_attempts(t.handshakes, tables.registry(t.devices))
    opens = t.handshakes.select("conn_key", "opened_at")
    end = spark.createDataFrame([(-1, datetime(2030, 1, 1), "open")], "conn_key long, ts timestamp, event string")
    events = handshake.decisive_events(opens, attempts)
    source = str(tmp_path / "events")
    events.coalesce(1).write.parquet(source)
    end.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = str(tmp_path / "out")
    (handshake.handshake_verdict_stream(stream).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination())
    got = {r.conn_key: (r.verdict, r.decided_at) for r in spark.read.parquet(out).collect()}
    want = {r.conn_key: (r.verdict, r.decided_at) for r in conns.handshake_verdicts(
        conns.handshake_steps(opens, attempts), datetime(2030, 1, 1)).collect()}
    assert got == want and {v for v, _ in got.values()} == {"accepted", "bad_key", "timeout"}


def test_exports(spark, t, tmp_path):
    from tidemark.operators import history
    export = history.device_export(t.readings, t.devices)
    one = history.device_export(t.readings, t.devices, device_id=11)
    sinks.write_export(one, str(tmp_path / "one"))
    text = spark.read.option("header", True).csv(str(tmp_path / "one"))
    assert text.columns == ["ts", "sensor_type", "value"] and text.count() == one.count() > 0
    sinks.write_exports(export, str(tmp_path / "all"), buckets=4)
    assert spark.read.option("header", True).csv(str(tmp_path / "all")).count() == export.count()


def test_queue_records(spark):
    records = spark.createDataFrame(
        [(i, "devices", 7, f'{{"device_id":{i % 50}}}') for i in range(100)] + [(100, "user:1", None, "{}")],
        "update_id long, audience string, skip_conn_key long, payload string")
    found = sinks.queue_records(records, parts=8).collect()
    assert (found[-1].key, found[-1].value) == ("user:1", "{}") and bytes(found[0].headers[0]["value"]) == b"7"
    keys = [r.key for r in found[:-1]]
    assert keys[:50] == keys[50:] and 4 < len(set(keys)) <= 8 and all(k.startswith("devices:") for k in keys)


def test_request_without_opening_leaves_no_state(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    first = [(1, at(0), "open"), (1, at(1), "good"), (2, at(1), "bad")]
    source, schema = str(tmp_path / "events"), "conn_key long, ts timestamp, event string"
    for later in (first, [(-1, datetime(2030, 1, 1), "open")], [(-2, datetime(2031, 1, 1), "open")]):
        spark.createDataFrame(later, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = (handshake.handshake_verdict_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
           .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    run.awaitTermination()
    assert {(r.conn_key, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {(1, "accepted")}
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "c"))
    assert {r.key.conn_key for r in state.select("key").collect()} <= {-1, -2}


def test_fixed_schema_reader(spark, t, tmp_path):
    t.readings.write.parquet(str(tmp_path / "r"))
    assert tables.read_table(spark, str(tmp_path / "r"), "sensor_data").schema == READINGS
    assert CONNECTION_EVENTS.fieldNames() == tables.connection_events(t.connections).columns


def test_two_sources_share_a_table(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "shared"), "x long")
    frame = lambda *x: spark.createDataFrame([(i,) for i in x], "x long")
    values = lambda **k: sorted(r.x for r in table.read(**k).collect())
    table.write(0, frame(1), "device")
    table.write(0, frame(2), "dashboard")
    table.write(0, frame(3), "dashboard")  # a replay
    table.write(1, frame(4), "device")
    assert values() == [1, 3, 4] and values(before=1) == [1, 3]
    table.compact(lambda rows: rows)
    table.write(2, frame(5), "device")
    assert values() == [1, 3, 4, 5]


def test_batch_that_completes_during_compaction_is_read_once(spark, tmp_path):
    table = BatchTable(spark, str(tmp_path / "race"), "x long")
    table.write(0, spark.createDataFrame([(1,)], "x long"))

    def fold(rows):
        table.write(1, spark.createDataFrame([(2,)], "x long"))
        return rows
    table.compact(fold)
    assert sorted(r.x for r in table.read().collect()) == [1, 2]


def test_recent_prunes_days(spark, tmp_path):
    from datetime import datetime

    from tidemark.operators import history
    store = jobs.IngestStore(spark, str(tmp_path))
    rows = spark.sql("SELECT 1L data_id, 2L device_id, 's' sensor_type, 'v' value, "
                     "TIMESTAMP_NTZ '2024-01-05 00:00:00' ts, DATE '2024-01-05' day")
    store.readings.write(0, rows.select(*store.readings.schema.fieldNames()), "device")
    plan = history.recent(store.readings.read(), datetime(2024, 1, 6))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_timers_need_no_module_path(tmp_path):
    """The driver's worker for the state processor does not look among the files added to a session."""
    import subprocess
    import sys

    from pyspark import cloudpickle
    (tmp_path / "processor").write_bytes(cloudpickle.dumps(handshake.handshake_processor()))
    code = "import sys; from pyspark import cloudpickle; cloudpickle.load(open('processor', 'rb')); assert 'tidemark' not in sys.modules"
    subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, check=True)


def test_timers_whatever_state_store_the_session_names(spark, tmp_path):
    other = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    was = spark.conf.get(handshake.STATE_STORE)
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    source, schema = str(tmp_path / "events"), "conn_key long, ts timestamp, event string"
    rows = [(1, at(0), "open"), (1, at(1), "good"), (2, at(0), "open"), (2, at(1), "bad"), (2, at(1), "good"), (3, at(0), "open"),
            (3, at(20), "good"), (4, at(0), "open"), (4, at(2), "good"), (4, at(1), "bad"), (-1, datetime(2030, 1, 1), "clock")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    spark.conf.set(handshake.STATE_STORE, other)
    try:
        verdicts = handshake.handshake_verdict_stream(spark.readStream.schema(schema).parquet(source))
        handshake.write_verdicts(verdicts, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
        assert spark.conf.get(handshake.STATE_STORE) == other
    finally:
        spark.conf.set(handshake.STATE_STORE, was)
    assert {(r.conn_key, r.verdict, r.decided_at) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {
        (1, "accepted", at(1)), (2, "accepted", at(1)), (3, "timeout", at(20)), (4, "bad_key", at(1))}


def test_timers_of_connections_that_share_a_block(spark, tmp_path, monkeypatch):
    """State is kept by block, yet each connection is decided by its own limit and when the clock passes that."""
    monkeypatch.setattr(handshake, "BLOCKS", 4)
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    source, schema = str(tmp_path / "events"), "conn_key long, ts timestamp, event string"
    few = [(None, at(3), "open"), (None, at(4), "good"), (1 << 60, at(3), "open"), ((1 << 60) + 1, at(3), "open"), ((1 << 60) + 1, at(5), "bad"),
           (900, at(9), "good"), (901, at(8), "good"), (902, at(0), "open"), (902, at(20), "good"), (903, at(0), "open"), (903, at(6), "bad")]
    batches = [[(i, at(i % 10), "open") for i in range(200)] + few + [(-1, at(6), "clock")],
               [(i, at(i % 10 + 8), "good") for i in range(0, 200, 2)] + [(900, at(7), "open"), (903, at(7), "good"), (-1, at(25), "clock")],
               [(i, at(26), "bad") for i in range(200)] + [(-1, at(26), "clock")],
               [(-1, at(3600), "clock")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got, waiting = [], []

    def take(frame, number):
        found = [(r.conn_key, r.verdict, r.decided_at) for r in frame.collect()]
        assert number < 2 or all(when <= at(26) for _, _, when in found)
        got.extend(found)
        waiting.append(len(found))

    (handshake.handshake_verdict_stream(stream).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c"))
     .trigger(availableNow=True).start().awaitTermination())
    want = {(i, "accepted", at(i % 10 + 8)) if i % 2 == 0 else (i, "bad_key", at(26)) if i % 10 > 6 else (i, "timeout", at(i % 10 + 20))
            for i in range(200)}
    want |= {(None, "accepted", at(4)), (1 << 60, "timeout", at(23)), ((1 << 60) + 1, "bad_key", at(5)),
             (900, "accepted", at(9)), (902, "timeout", at(20)), (903, "bad_key", at(6))}
    assert len(got) == len(want) and set(got) == want
    assert sum(n > 0 for n in waiting) > 1  # not all at the end
    states = lambda **of: spark.read.format("statestore").options(stateVarName="waiting", **of).load(str(tmp_path / "c"))
    assert 1 < states(batchId=0).count() <= 5 and states().count() == 0
