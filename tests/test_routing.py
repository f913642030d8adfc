"""Routing against pair-by-pair brute force on a small set."""

from datetime import datetime, timedelta

import pytest

from tidemark.operators import routing
from tidemark.schemas import CONNECTIONS, DEVICES

NOW = datetime(2024, 1, 10)
EARLY = NOW - timedelta(hours=2)
LATER = NOW + timedelta(hours=1)

DEVICE_ROWS = [(1, 10, "one", "a1", "s1", "garden"), (2, 10, "two", "a2", "s2", None), (3, 11, "three", "a3", "s3", ""),
               (4, 12, "four", "a4", "s4", "roof")]
# conn_key, type, device, user, slug, opened, authenticated, closed
CONNECTION_ROWS = [
    (100, "dashboard", 1, 10, None, EARLY, EARLY, None),
    (101, "dashboard", 1, 10, None, EARLY, EARLY, EARLY),
    (102, "dashboard", 3, 11, None, EARLY, None, None),
    (103, "dashboard", 3, 11, None, EARLY, EARLY, LATER),
    (200, "device", 1, 10, None, EARLY, EARLY, None),
    (201, "device", 1, 10, None, EARLY, EARLY, None),
    (202, "device", 2, 10, None, EARLY, EARLY, EARLY),
    (203, "device", 3, 11, None, EARLY, None, None),
    (204, "device", 4, 12, None, EARLY, LATER, None),
    (205, "device", 3, 11, None, LATER, LATER, None),
    (300, "public", 1, 10, "garden", EARLY, None, None),
    (301, "public", 1, 10, "garden", EARLY, None, EARLY),
    (302, "public", 3, 11, "", EARLY, None, None),
    (303, "public", 2, 10, None, EARLY, None, None),
]
UPDATE_ROWS = [(1, 1, "view", "5", NOW, "data", 200), (2, 1, "led", "true", NOW, "command", 201),
               (3, 2, "view", None, NOW, "data", None), (4, 3, "view", "7", NOW, "data", 203),
               (5, 9, "view", "1", NOW, "data", None), (6, 1, "view", "6", NOW, "data", 201)]


@pytest.fixture(scope="module")
def frames(spark):
    devices = spark.createDataFrame(DEVICE_ROWS, DEVICES)
    connections = spark.createDataFrame(CONNECTION_ROWS, CONNECTIONS)
    updates = spark.createDataFrame(UPDATE_ROWS, "update_id long, device_id long, sensor_type string, value string, "
                                                 "ts timestamp_ntz, kind string, sender_key long")
    return devices, connections, updates


def live(row):
    return row[5] <= NOW and (row[7] is None or row[7] > NOW) and (
        row[1] == "public" or (row[6] is not None and row[6] <= NOW))


def pairs():
    """Every (update, connection) delivery, one at a time."""
    owners = {d[0]: d for d in DEVICE_ROWS}
    for update_id, device_id, _, _, _, kind, sender in UPDATE_ROWS:
        device = owners.get(device_id)
        for conn in filter(live, CONNECTION_ROWS):
            if device and (conn[1] == "dashboard" and conn[3] == device[1]
                           or conn[1] == "public" and device[5] and conn[4] == device[5]
                           or conn[1] == "device" and kind == "data" and conn[0] != sender):
                yield update_id, conn[0]


def test_feeds_are_the_pairs(frames):
    devices, connections, updates = frames
    records = routing.outbox(routing.with_owner(updates, devices))
    subs = routing.subscriptions(connections, NOW)
    got = [(r.update_id, c[0]) for c in CONNECTION_ROWS for r in routing.feed(records, subs, c[0]).collect()]
    assert sorted(got) == sorted(pairs()) and len(got) > 5


def test_counts_follow_from_the_pairs(frames):
    devices, connections, updates = frames
    data = updates.where("kind = 'data'")
    subs = routing.subscriptions(connections, NOW)
    kinds = {c[0]: c[1] for c in CONNECTION_ROWS}
    want = {}
    ids = {r.update_id for r in data.collect()}
    for update_id, conn in pairs():
        if update_id in ids:
            want[(update_id, kinds[conn])] = want.get((update_id, kinds[conn]), 0) + 1
    rows = routing.delivery_counts(data, devices, subs).collect()
    got = {(r.update_id, k): n for r in rows
           for k, n in (("dashboard", r.n_dashboards), ("device", r.n_devices), ("public", r.n_public)) if n}
    assert got == want and len(rows) == 4


@pytest.mark.parametrize("operator, kind", [(routing.dashboard_receivers, "dashboard"),
                                            (routing.device_receivers, "device"), (routing.public_receivers, "public")])
def test_receivers_follow_from_the_pairs(frames, operator, kind):
    devices, connections, updates = frames
    data = updates.where("kind = 'data'")
    ids = {r.update_id for r in data.collect()}
    want = {c[0]: (0, 0) for c in CONNECTION_ROWS if c[1] == kind and live(c) and (kind != "public" or c[4])}
    for update_id, conn in pairs():
        if update_id in ids and conn in want:
            n, total = want[conn]
            want[conn] = n + 1, total + update_id
    rows = operator(data, devices, routing.subscriptions(connections, NOW)).collect()
    assert {r.conn_key: (r.n_updates, int(r.id_sum)) for r in rows} == want


def test_owner_scope_differs(frames):
    devices, connections, updates = frames
    subs = routing.subscriptions(connections, NOW)
    of_all = routing.device_receivers(updates, devices, subs).agg({"n_updates": "sum"}).first()[0]
    of_owner = routing.device_receivers(updates, devices, subs, scope="owner").agg({"n_updates": "sum"}).first()[0]
    assert 0 < of_owner < of_all


def test_command_replies(spark, frames):
    _, connections, _ = frames
    commands = spark.createDataFrame(
        [(1, 1, "1", "led", "true", None), (2, 1, "1", "led", None, 200), (3, 2, "2", "led", "x", None),
         (4, 3, "3", "led", "x", None), (5, 3, "3", "led", None, 203), (6, 99, "99", "led", "x", None),
         (7, 2, "2", "led", "x", 202), (8, None, "abc", "led", "x", None)],
        "msg_id long, target_id long, target_text string, sensor_type string, value string, sender_key long")
    rows = {r.msg_id: (r.n_sent, r.message is not None, r.val)
            for r in routing.command_acks(commands, connections, NOW).collect()}
    assert rows == {
        1: (2, False, "true"), 2: (1, False, "null"),
        3: (0, True, "x"),  # its only connection is closed
        4: (0, True, "x"), 5: (0, True, None), 6: (0, True, "x"),
        7: (0, True, "x"),  # the sender's own connection does not count
        8: (0, True, "x")}


def test_payloads(frames):
    devices, _, updates = frames
    records = routing.outbox(routing.with_owner(updates, devices))
    got = {r.audience: r.payload for r in records.where("update_id = 1").collect()}
    assert got == {
        "user:10": '{"device":"one","device_id":1,"var":"view","val":"5","timestamp":"2024-01-10T00:00:00.000Z"}',
        "slug:garden": '{"type":"dataUpdate","sensor_type":"view","current_value":"5","timestamp":"2024-01-10T00:00:00.000Z"}',
        "devices": '{"type":"dataUpdate","device_id":1,"device_name":"one","var":"view","val":"5",'
                   '"timestamp":"2024-01-10T00:00:00.000Z"}'}
    assert '"val":null' in records.where("update_id = 3").first().payload
