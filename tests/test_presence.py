"""Connection state at each message's own time, against loops over all connections."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest, presence, routing
from tidemark.schemas import CONNECTIONS, DEVICES
from tidemark.sources.testdata import TestTables
from tidemark.streaming import jobs

START = datetime(2024, 1, 1)
MESSAGE = "msg_id long, ts timestamp_ntz, conn_type string, outcome string, target_id long"


def moment(rng, minutes):
    return START + timedelta(minutes=rng.randrange(minutes))


def random_rows(seed, n_connections=200, n_messages=300, minutes=900):
    rng = random.Random(seed)
    connections = []
    for key in range(n_connections):
        opened = moment(rng, minutes) - timedelta(minutes=rng.choice([0, 0, 500, 5000]))
        auth = rng.choice([None, opened, opened + timedelta(minutes=rng.randrange(40)), opened - timedelta(minutes=3)])
        closed = rng.choice([None, opened + timedelta(minutes=rng.randrange(600)), opened])
        device = 1 if rng.random() < 0.4 else rng.choice([2, 3, 4, 5, None])  # a busy one
        connections.append((key, rng.choice(["device"] * 4 + ["dashboard", "public"]), device, 1, None, opened, auth, closed))
    messages = [(i, rng.choice([moment(rng, minutes), START + timedelta(minutes=rng.choice([0, 60, 120]))]),
                 rng.choice(["device", "device", "dashboard"]), rng.choice(["command", "data", "invalid"]),
                 rng.choice([1, 1, 2, 3, 4, 5, 9, None])) for i in range(n_messages)]
    return connections, messages + [(n_messages, None, "device", "command", 1)]


def open_spans(connections, device, ts):
    spans = [(max(c[5], c[6]), c[0], c[7]) for c in connections
             if c[1] == "device" and c[2] == device and device is not None and c[6] is not None
             and (c[7] is None or c[7] > max(c[5], c[6]))]
    started = sorted(s for s in spans if ts is not None and s[0] <= ts)
    return started, [s for s in started if s[2] is None or s[2] > ts]


@pytest.mark.parametrize("seed, hours", [(1, 24), (2, 1), (3, 5)])
def test_state_of_each_message_equals_loops(spark, seed, hours):
    connections, messages = random_rows(seed)
    conns, frame = spark.createDataFrame(connections, CONNECTIONS), spark.createDataFrame(messages, MESSAGE)
    steps = presence.presence_steps(conns, *presence.time_span(frame), hours)
    got = {r["msg_id"]: (r["sender_key"], r["n_sent"]) for r in presence.with_senders(frame, steps, hours=hours).collect()}
    want = {}
    for msg_id, ts, kind, outcome, target in messages:
        started, open_ = open_spans(connections, target if outcome != "invalid" else None, ts)
        sender = started[-1][1] if started and started[-1] in open_ and kind == "device" else None
        want[msg_id] = (sender, len(open_) - (sender is not None))
    assert got == want and len(set(want.values())) > 20

    # With the connection of each message known.
    rng = random.Random(seed)
    senders = {m[0]: rng.choice([None, *range(200)]) for m in messages}
    given = spark.createDataFrame([(*m, senders[m[0]]) for m in messages], MESSAGE + ", sender_key long")
    found = presence.with_senders(given, steps, conns, hours).collect()
    for r in found:
        _, open_ = open_spans(connections, r["target_id"] if r["outcome"] != "invalid" else None, r["ts"])
        assert r["n_sent"] == len([s for s in open_ if s[1] != r["sender_key"]]), r
    assert {r["msg_id"]: r["sender_key"] for r in found} == senders


def test_steps_cover_only_the_messages(spark):
    connections, _ = random_rows(4)
    steps = presence.presence_steps(spark.createDataFrame(connections, CONNECTIONS), START, START + timedelta(hours=3), 1)
    first = presence.slice_number(START, 1)
    assert {r["slice"] for r in steps.select("slice").distinct().collect()} <= set(range(first, first + 4))
    none = presence.stored_steps(spark.createDataFrame([], CONNECTIONS), None, None)
    assert none.count() == 0


def test_no_messages(spark):
    frame = spark.createDataFrame([], MESSAGE)
    steps = presence.stored_steps(spark.createDataFrame([], CONNECTIONS), *presence.time_span(frame))
    assert presence.with_senders(frame, steps).columns == [*frame.columns, "sender_key", "n_sent"]
    assert presence.with_senders(frame, steps).count() == 0


def rows(frame):
    return sorted(map(tuple, frame.select(sorted(frame.columns)).collect()), key=repr)


def test_replies_do_not_depend_on_batches(spark, tmp_path):
    """One, four and ten batches give the rows of one pass."""
    t = TestTables(spark, "/root/testdata/sf0.001")
    placed = jobs.decided(t.messages, t.devices, t.connections, "device").persist()
    answers = rows(ingest.reply_frames(ingest.replies(placed)).drop("payload_value"))
    records = rows(routing.outbox(routing.with_owner(ingest.new_updates(placed), t.devices)))
    assert {r["n_sent"] for r in placed.select("n_sent").distinct().collect()} > {0, 1}
    assert placed.where("sender_key is not null").count() > 50
    for n in (1, 4, 10):
        store = jobs.IngestStore(spark, str(tmp_path / str(n)))
        work = jobs.ingest_batch(store, lambda: (t.devices, t.connections))
        for i in range(n):
            work(t.messages.where(F.col("msg_id") % n == i), i)
        assert rows(store.replies.read()) == answers
        assert rows(store.outbox.read()) == records


def test_offline_note_follows_the_time(spark):
    devices = spark.createDataFrame([(1, 1, "one", "a", "k", None)], DEVICES)
    at = lambda h: START + timedelta(hours=h)
    connections = spark.createDataFrame([(7, "device", 1, 1, None, at(1), at(1), at(2)), (8, "device", 1, 1, None, at(1), at(1), at(3))],
                                        CONNECTIONS)
    batch = spark.createDataFrame([(h, at(h), 1, '{"device_id":1,"var":"led","val":"on"}') for h in range(5)],
                                  "msg_id long, ts timestamp_ntz, user_id long, raw string")
    placed = jobs.decided(batch, devices, connections, "dashboard")
    assert {r["msg_id"]: (r["n_sent"], r["message"] is None) for r in routing.command_acks(
        ingest.new_commands(placed)).collect()} == {0: (0, False), 1: (2, True), 2: (1, True), 3: (0, False), 4: (0, False)}


def test_connections_are_reduced_in_one_shuffle(spark):
    connections, _ = random_rows(4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        steps = presence.presence_steps(spark.createDataFrame(connections, CONNECTIONS), START, START + timedelta(hours=9), 1)
        plan = steps._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "ReusedExchange" in plan and plan.count("Scan") == 1


def test_a_batch_makes_steps_of_its_own_devices_only(spark, tmp_path, monkeypatch):
    devices = spark.createDataFrame([(d, 1, f"d{d}", f"a{d}", f"s{d}", None) for d in (1, 2, 3, 4)], DEVICES)
    connections = spark.createDataFrame(
        [(10 * (d or 9) + n, "device", d, 1, None, START, START, None) for d in (1, 2, 3, 4, None) for n in (0, 1)], CONNECTIONS)
    batch = spark.createDataFrame(
        [(1, START + timedelta(hours=1), "s1", '{"var":"a","val":1}'), (2, START + timedelta(hours=1), "s2", '{"var":"a"}'),
         (3, START + timedelta(hours=1), "s4", '{"type":"command","var":"a","val":null}'), (4, START, "none", "x")],
        "msg_id long, ts timestamp_ntz, secret_key string, raw string")
    seen, whole = [], presence.presence_steps

    def watched(rows, *moments):
        seen.append(sorted(r[0] for r in rows.select("device_id").collect()))
        return whole(rows, *moments)

    monkeypatch.setattr(presence, "presence_steps", watched)
    store = jobs.IngestStore(spark, str(tmp_path))
    jobs.ingest_batch(store, lambda: (devices, connections))(batch, 0)
    assert seen == [[1, 1, 4, 4]]
    # The update skips its sender's connection, the last that started; the command reached the other one.
    assert [(r.update_id, r.skip_conn_key) for r in store.outbox.read().where("audience = 'devices'").collect()] == [(1, 11)]
    assert sorted((r.msg_id, r.message) for r in store.replies.read().collect()) == [(1, ingest.RECEIVED), (3, None)]
