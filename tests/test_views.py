"""History, state, series, display and handshakes on hand-made rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bundle, connections as conns, display, history, series, state
from tidemark.schemas import DEVICES, READINGS, WIDGETS
from tidemark.sources import tables

NOW = datetime(2026, 4, 15, 18)


def readings(spark, *rows):
    return spark.createDataFrame([(i, 1, s, v, t) for i, (s, v, t) in enumerate(rows)], READINGS)


@pytest.mark.parametrize("mode, kept", [("reference", {1, 2, 3}), ("exact", {2, 3})])
def test_window_modes(spark, mode, kept):
    rows = readings(spark, ("a", "1", datetime(2026, 4, 13, 23, 59, 59, 999000)),
                    ("a", "2", datetime(2026, 4, 14, 0, 0, 0, 1000)), ("a", "3", datetime(2026, 4, 14, 18)), ("a", "4", NOW))
    assert {r.data_id for r in history.recent(rows, NOW, mode).collect()} == kept


def test_window_on_zoned_time(spark):
    rows = readings(spark, ("a", "1", datetime(2026, 4, 14, 0, 0, 0, 1000))).withColumn("ts", F.col("ts").cast("timestamp"))
    assert history.recent(rows, NOW).count() == 1 and history.recent(rows, NOW, "exact").count() == 0


def test_latest_value_and_ties(spark):
    rows = readings(spark, ("a", "1", NOW), ("a", "2", NOW), ("a", "3", NOW - timedelta(1)), ("b", None, NOW))
    assert {r.sensor_type: r.value for r in state.current_values(rows).collect()} == {"a": "2", "b": None}


def test_null_is_a_value_for_widgets(spark):
    widgets = spark.createDataFrame([(1, 1, 1, "b", "text", "x", "old"), (2, 1, 1, "b", "text", "x", "old"),
                                     (3, 1, 1, "c", "text", "x", "old")], WIDGETS)
    latest = state.current_values(readings(spark, ("b", None, NOW)))
    got = {r.widget_id: r.current_value for r in state.update_widgets(widgets, latest).collect()}
    assert got == {1: None, 2: None, 3: "old"}


def test_series_chunks_are_whole_and_ordered(spark):
    rows = spark.range(3000).select(F.col("id").alias("data_id"), F.lit(1).cast("long").alias("device_id"),
                                    F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("sensor_type"),
                                    F.col("id").cast("string").alias("value"),
                                    F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"))
    chunks = series.series_chunks(rows, chunk_bits=6).orderBy("sensor_type", "chunk").collect()
    assert max(len(c["values"]) for c in chunks) <= 64
    hot = [int(v) for c in chunks if c.sensor_type == "hot" for v in c["values"]]
    assert hot == list(range(2900))
    assert chunks[-1].labels[0] != chunks[0].labels[0]


def test_last_points(spark):
    rows = readings(spark, *[("a", str(i), NOW + timedelta(seconds=i)) for i in range(50)])
    row = series.live_series(rows, 40).first()
    assert row["values"] == [str(i) for i in range(10, 50)] and row.labels[0] == "18:00:10"


def test_display(spark):
    widgets = spark.createDataFrame(
        [(1, 1, 1, "a", "text", "x", ""), (2, 1, 1, "b", "text", "x", "0"), (3, 1, 1, "c", "text", "x", None),
         (4, 1, 1, "a", "graph", "x", ""), (5, 1, 1, "a", "gauge", "integer", "150"), (6, 1, 1, "a", "slider", "x", "300.9"),
         (7, 1, 1, "a", "toggle", "x", "true"), (8, 1, 1, "a", "toggle", "x", "1"), (9, 1, 1, "d", "text", "x", "")], WIDGETS)
    newest = state.current_values(readings(spark, ("a", "1", NOW), ("a", "2", NOW), ("d", "", NOW)))
    rows = {r.widget_id: r for r in display.widget_display(widgets, newest).collect()}
    assert {k: r.shown for k, r in rows.items()} == {1: "2", 2: "0", 3: "-", 4: "-", 5: "150", 6: "300", 7: "NYALA",
                                                     8: "MATI", 9: ""}
    assert (rows[5].gauge_value, rows[5].gauge_rest) == (150, -50)
    assert (rows[6].slider_value, rows[6].slider_min, rows[6].slider_max) == (300, 0, 255)


def test_widgets_without_readings_stay(spark):
    widgets = spark.createDataFrame([(1, 1, 1, "a", "text", "x", ""), (2, 1, 1, "z", "text", "x", "")], WIDGETS)
    got = series.widget_readings(widgets, readings(spark, ("a", "1", NOW), ("a", "2", NOW), ("q", "3", NOW))).collect()
    assert sorted((r.widget_id, r.value) for r in got if r.value) == [(1, "1"), (1, "2")]
    assert [r.widget_id for r in got if r.value is None] == [2]


def test_bundle_parts(spark):
    devices = spark.createDataFrame([(1, 1, "one", "a", "s", "garden")], DEVICES)
    widgets = spark.createDataFrame([(7, 1, 1, "a", "text", "x", "v")], WIDGETS)
    asked = spark.createDataFrame([(1, "/garden"), (2, "/api/public/view/garden"), (3, "/nowhere")], "request_id long, path string")
    pages = history.slug_lookup(asked, devices)
    assert {r.request_id: r.status for r in pages.collect()} == {1: 200, 2: 200, 3: 404}
    rows = bundle.bundle_rows(pages, widgets, readings(spark, ("a", "1", NOW), ("a", "0", NOW - timedelta(3))), NOW)
    parts = bundle.bundle_json(bundle.bundle_chunks(rows)).orderBy("part").collect()
    assert [p.part for p in parts] == ["device", "reading", "widget"]
    assert '"value":"1"' in parts[1]["items"] and '"value":"0"' not in parts[1]["items"]


def test_handshake_cases(spark):
    start = datetime(2024, 1, 1)
    at = lambda s: start + timedelta(seconds=s)
    opens = spark.createDataFrame([(i, start) for i in range(1, 8)], "conn_key long, opened_at timestamp_ntz")
    good, bad, other = '{"action":"auth","key":"k"}', '{"action":"auth","key":"nope"}', '{"var":"x","val":1}'
    sent = spark.createDataFrame(
        [(1, at(19), good), (2, at(5), other), (3, at(1), bad), (3, at(2), good), (4, at(20), good), (5, at(1), other),
         (5, at(2), "nojson"), (5, at(3), good), (7, at(1), '{"action":"auth","key":""}')],
        "conn_key long, ts timestamp_ntz, raw string")
    devices = spark.createDataFrame([(1, 1, "one", "a", "k", None), (2, 1, "two", "b", "", None)], DEVICES)
    attempts = conns.auth_attempts(sent, tables.registry(devices))
    steps = conns.handshake_steps(opens, attempts)
    verdicts = {r.conn_key: (r.verdict, (r.decided_at - start).seconds)
                for r in conns.handshake_verdicts(steps, at(60)).collect()}
    assert verdicts == {1: ("accepted", 19), 2: ("timeout", 20), 3: ("bad_key", 1), 4: ("timeout", 20),
                        5: ("accepted", 3), 6: ("timeout", 20), 7: ("timeout", 20)}
    early = {r.conn_key: r.verdict for r in conns.handshake_verdicts(steps, at(2)).collect()}
    assert early[1] == early[5] == "pending" and early[3] == "bad_key"
    replies = conns.handshake_replies(attempts).where("conn_key = 5").orderBy("ts").collect()
    assert [r.status for r in replies] == ["error", "success"]


def test_connection_state(spark):
    start = datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [(1, "open", start), (2, "open", start), (2, "auth", start), (3, "open", start), (3, "auth", start),
         (3, "close", start), (4, "close", start), (4, "open", start + timedelta(1))],
        "conn_key long, event string, ts timestamp_ntz")
    got = {r.conn_key: r.state for r in conns.connection_state(conns.connection_steps(events)).collect()}
    assert got == {1: "open", 2: "authenticated", 3: "closed", 4: "open"}
