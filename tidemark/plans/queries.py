"""Every registered query, over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import payload, scalars
from tidemark.operators import (bundle, changes, connections as conns, display, history, ingest, presence, routing,
                                series, state)
from tidemark.operators.numbering import positions
from tidemark.session import new_path, stored
from tidemark.sources import tables
from tidemark.sources.testdata import TestTables
from tidemark.streaming import handshake, jobs, sinks
from tidemark.streaming.log import BatchTable

KEY_SEED = "test"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[TestTables], DataFrame]) -> Callable[[TestTables], DataFrame]:
    QUERIES[function.__name__] = lambda spark, folder: function(TestTables(spark, folder))
    return function


# Small tables derived by joins are stored first: an estimate of a join's size is useless, while the size of
# files tells Spark whether to broadcast them to the large side or to shuffle.

def updates(t: TestTables) -> DataFrame:
    """Every reading as an update, sent over the newest connection of its device."""
    sender = stored(conns.newest_connections(t.connections)
                    .select("device_id", F.col("conn_key").alias("sender_key")), "senders")
    return (t.readings.withColumnRenamed("data_id", "update_id").withColumn("kind", F.lit("data"))
            .join(sender, "device_id", "left"))


def device_messages(t: TestTables) -> DataFrame:
    """Messages on device connections, decided."""
    return jobs.decisions(t.messages, t.devices, "device")


def dashboard_messages(t: TestTables) -> DataFrame:
    """The same messages as typed by the device owners on their dashboards."""
    owned = ingest.authenticate(payload.with_fields(t.messages).drop("raw"), tables.registry(t.devices)).where("accepted")
    return ingest.dashboard_outcomes(owned.withColumn("conn_type", F.lit("dashboard")))


def steps(t: TestTables) -> DataFrame:
    """Who is connected while the messages arrive."""
    return presence.stored_steps(t.connections, *presence.time_span(t.messages))


def live_widgets(t: TestTables) -> DataFrame:
    return state.update_widgets(t.widgets, state.current_values(t.readings))


def now(t: TestTables):
    return history.latest_time(t.readings)


# Scans, history and lookups

@query
def J1_readings_24h(t):
    return history.owner_history(t.readings, t.devices, now(t))


@query
def J1_readings_24h_exact(t):
    return history.owner_history(t.readings, t.devices, now(t), mode="exact")


@query
def P2_device_readings_24h(t):
    return history.device_history(t.readings, now(t))


@query
def J2_device_export(t):
    return history.device_export(t.readings, t.devices)


@query
def J2_requested_exports(t):
    requests = t.widgets.select("device_id", "user_id")
    return history.requested_exports(requests, t.readings, t.devices)


@query
def J3_widgets_with_device(t):
    return history.widgets_with_device(t.widgets, t.devices)


@query
def J4_public_lookup(t):
    return history.public_lookup(t.lookup_requests, t.users, t.devices)


@query
def J5_slug_lookup(t):
    return history.slug_lookup(t.page_requests, t.devices)


@query
def P1_devices_of_users(t):
    return history.devices_of(t.devices)


@query
def P1_user_by_name(t):
    return history.user_by_name(t.users, "NATION_7")


@query
def P1_widgets_of_devices(t):
    return history.widgets_of_device(t.widgets)


@query
def S3_registry(t):
    return tables.registry(t.devices)


@query
def P4_missing_keys(t):
    return tables.missing_key(t.devices).select("device_id", "secret_key")


@query
def F14_query_fields(t):
    url = F.col("url")
    return t.raw("pages").select("page_id", scalars.query_field(url, "utm_source").alias("utm_source"),
                                 scalars.query_field(url, "page").alias("page"),
                                 scalars.query_field(url, "ref").alias("ref"))


@query
def A2_counts(t):
    return history.rows_per_owner(t.readings, t.devices, t.users, now(t))


@query
def A2_registry_counts(t):
    """Keys that can authenticate and devices that cannot, per owner."""
    missing = tables.missing_key(t.devices).select("user_id", F.lit(1).alias("missing"))
    known = tables.registry(t.devices).select("user_id", F.lit(0).alias("missing"))
    return known.unionByName(missing).groupBy("user_id").agg(
        F.sum(1 - F.col("missing")).alias("n_keys"), F.sum("missing").alias("n_missing"))


# Current values, series, display

@query
def A1_current_values(t):
    return state.current_values(t.readings)


@query
def K2_widget_snapshot(t):
    return live_widgets(t)


@query
def W1_last_40_points(t):
    return series.last_points(t.readings).withColumn("rank", F.col("rank").cast("long"))


@query
def W1_last_10_points(t):
    return series.last_points(t.readings, 10).withColumn("rank", F.col("rank").cast("long"))


@query
def W4_visible_widgets(t):
    return state.visible_widgets(t.widgets)


@query
def J13_widget_readings(t):
    return series.widget_readings(t.widgets, history.recent(t.readings, now(t)))


@query
def A4_series_rows(t):
    chunks = series.widget_series(t.widgets, history.recent(t.readings, now(t)))
    rows = chunks.select("widget_id", "device_id", "sensor_type", F.inline(
        F.arrays_zip("points", "labels", "values")))
    return rows.select("widget_id", "device_id", "sensor_type", "points.data_id", "points.ts",
                       F.col("labels").alias("label"), F.col("values").alias("value"))


@query
def T6_live_series_rows(t):
    rows = series.live_series(t.readings).select("device_id", "sensor_type", F.posexplode(
        F.arrays_zip("labels", "values")))
    return rows.select("device_id", "sensor_type", F.col("pos").cast("long").alias("pos"),
                       F.col("col.labels").alias("label"), F.col("col.values").alias("value"))


@query
def D1_widget_display(t):
    newest = state.current_values(history.recent(t.readings, now(t)))
    return display.widget_display(live_widgets(t), newest)


@query
def A5_bundle_rows(t):
    pages = history.slug_lookup(t.page_requests, t.devices)
    chunks = bundle.bundle_chunks(bundle.bundle_rows(pages, t.widgets, t.readings, now(t)))
    return chunks.select("device_id", "part", F.inline("items"))


# Messages

@query
def J6_authenticated_messages(t):
    return (ingest.authenticate(t.messages, tables.registry(t.devices)).where("accepted")
            .select("msg_id", "auth_device_id", "device_name", "user_id"))


@query
def J6_rejected_messages(t):
    return (ingest.authenticate(t.messages, tables.registry(t.devices)).where("not accepted")
            .select("msg_id", "secret_key"))


@query
def M1_normalised_messages(t):
    return payload.with_fields(t.messages).select(
        "msg_id", "is_json", "name_ok", "sensor_type", "value_present", "value", "target_text", "is_command")


@query
def M2_message_class(t):
    known = device_messages(t).where("is_json")
    kind = F.col("conn_type")
    return known.select("msg_id", payload.message_class(kind, F.col("is_command")).alias("message_class"),
                        payload.priority(kind, F.col("is_command")).cast("long").alias("priority"))


@query
def M3_dashboard_class(t):
    known = dashboard_messages(t).where("is_json")
    kind = F.col("conn_type")
    return known.select("msg_id", payload.message_class(kind, F.col("is_command")).alias("message_class"),
                        payload.priority(kind, F.col("is_command")).cast("long").alias("priority"))


@query
def M5_auto_routed(t):
    known = ingest.authenticate(t.messages, tables.registry(t.devices))
    routed = payload.auto_route(known, "auth_device_id")
    fields = payload.with_fields(routed.select("msg_id", "auto_routed", "routed_raw"), "routed_raw")
    return fields.select("msg_id", "auto_routed", "is_command", "target_text", "sensor_type", "value")


@query
def M6_frame_class(t):
    answers = ingest.reply_frames(ingest.replies(presence.with_senders(device_messages(t), steps(t))))
    frames = (answers.select(F.lit("reply").alias("origin"), "msg_id", "frame")
              .unionByName(t.messages.select(F.lit("device").alias("origin"), "msg_id",
                                             F.col("raw").alias("frame")))
              .unionByName(routing.outbox(routing.with_owner(updates(t), t.devices)).select(
                  F.lit("outbox").alias("origin"), F.col("update_id").alias("msg_id"), F.col("payload").alias("frame"))))
    parsed = payload.compute_once(frames, {"document": payload.parse(F.col("frame"))})
    known = payload.compute_once(parsed, {"head": payload.frame_head(F.col("document"))})
    return known.select("origin", "msg_id", payload.frame_class(F.col("document"), F.col("head")).alias("frame_class"))


@query
def M7_command_text(t):
    command = F.col("command")
    return t.client_commands.select("msg_id", payload.command_word(command).alias("word"),
                                    payload.command_argument(command).alias("argument"))


@query
def V6_cross_device(t):
    return (device_messages(t).where("outcome = 'cross_device'")
            .select("msg_id", "auth_device_id", "target_text"))


@query
def T1_device_outcomes(t):
    return device_messages(t).select("msg_id", "outcome", "auth_device_id", "target_id", "sensor_type", "value")


@query
def K1_new_readings(t):
    return ingest.new_readings(device_messages(t))


@query
def T2_dashboard_commands(t):
    return ingest.with_ownership(dashboard_messages(t), t.devices).select(
        "msg_id", "user_id", "outcome", "target_id", "sensor_type", "value", "is_owner")


@query
def T3_controller_commands(t):
    return routing.command_acks(ingest.new_commands(presence.with_senders(device_messages(t), steps(t))))


@query
def J11_command_acks(t):
    commands = dashboard_messages(t).where("outcome = 'command'")
    return routing.command_acks(ingest.new_commands(presence.with_senders(commands, steps(t))))


@query
def T8_replies(t):
    known = steps(t)
    device, dashboard = (ingest.replies(presence.with_senders(messages, known)).withColumn("origin", F.lit(origin))
                         for origin, messages in (("device", device_messages(t)), ("dashboard", dashboard_messages(t))))
    return device.unionByName(dashboard).drop("payload_value")


# Routing

@query
def J7_update_enriched(t):
    owned = routing.with_owner(updates(t), t.devices)
    return routing.dashboard_updates(owned)


@query
def J8_public_updates(t):
    return routing.public_updates(routing.with_owner(updates(t), t.devices))


@query
def P7_subscriptions(t):
    return routing.subscriptions(t.connections, now(t)).select("conn_key", "conn_type", "audience")


@query
def K8_outbox(t):
    records = routing.outbox(routing.with_owner(updates(t), t.devices))
    parsed = payload.compute_once(records, {"body": F.try_parse_json("payload")})
    names = ("type", "device", "device_id", "device_name", "var", "sensor_type", "val", "current_value", "timestamp")
    return parsed.select("update_id", "audience", "skip_conn_key",
                         *[F.try_variant_get("body", f"$.{n}", "string").alias(n) for n in names])


@query
def J9_dashboard_recipients(t):
    return routing.dashboard_receivers(updates(t), t.devices, routing.subscriptions(t.connections, now(t)))


@query
def J10_device_recipients(t):
    return routing.device_receivers(updates(t), t.devices, routing.subscriptions(t.connections, now(t)))


@query
def J10_device_recipients_owner(t):
    return routing.device_receivers(updates(t), t.devices, routing.subscriptions(t.connections, now(t)),
                                    scope="owner")


@query
def J12_public_recipients(t):
    return routing.public_receivers(updates(t), t.devices, routing.subscriptions(t.connections, now(t)))


@query
def A3_delivery_counts(t):
    return routing.delivery_counts(updates(t), t.devices, routing.subscriptions(t.connections, now(t)))


# Connections

@query
def T5_connection_state(t):
    steps = conns.connection_steps(tables.connection_events(t.connections))
    return conns.connection_state(steps)


@query
def W5_newest_connection(t):
    return conns.newest_connections(t.connections, as_of=now(t)).select("device_id", "conn_key", "auth_at")


@query
def W5_coexisting_connections(t):
    return (conns.newest_connections(t.connections, "coexist", now(t))
            .select("device_id", "conn_key", "auth_at"))


@query
def T4_handshake(t):
    attempts = conns.auth_attempts(t.handshakes, tables.registry(t.devices))
    steps = conns.handshake_steps(t.handshakes.select("conn_key", "opened_at"), attempts)
    return conns.handshake_verdicts(steps, now(t))


@query
def T4_handshake_replies(t):
    attempts = conns.auth_attempts(t.handshakes, tables.registry(t.devices))
    steps = conns.handshake_steps(t.handshakes.select("conn_key", "opened_at"), attempts)
    return conns.handshake_replies(attempts, conns.handshake_verdicts(steps, now(t)))


@query
def K4_delete_results(t):
    return conns.delete_results(t.delete_requests, t.devices, "device_id")


def deleted_devices(t):
    return conns.deleted_ids(conns.delete_results(t.delete_requests, t.devices, "device_id"), "device_id")


@query
def J14_after_device_delete(t):
    return conns.without(t.devices, deleted_devices(t), "device_id").select("device_id", "user_id", "device_name")


@query
def J14_revoked_keys(t):
    return conns.revoked_keys(tables.registry(t.devices), deleted_devices(t)).select("device_id", "secret_key")


@query
def T9_close_events(t):
    return conns.close_events(t.connections, deleted_devices(t), now(t))


# Changes

@query
def A6_duplicate_keys(t):
    return changes.duplicate_keys(t.registrations, t.users, ["username", "email"])


@query
def V1_registrations(t):
    return changes.registration_results(t.registrations, t.users)


@query
def K3_inserted_users(t):
    return changes.insert_users(changes.registration_results(t.registrations, t.users), 1000)


@query
def V2_devices(t):
    return changes.device_results(t.device_requests).withColumn("status", F.col("status").cast("long"))


@query
def K3_inserted_devices(t):
    return changes.insert_devices(changes.device_results(t.device_requests), 1_000_000, KEY_SEED)


@query
def V3_widgets(t):
    return changes.widget_results(t.widget_requests).withColumn("status", F.col("status").cast("long"))


@query
def K3_inserted_widgets(t):
    return changes.insert_widgets(changes.widget_results(t.widget_requests), 1_000_000)


@query
def V4_slugs(t):
    return changes.slug_results(t.slug_requests, t.devices).withColumn("status", F.col("status").cast("long"))


@query
def K5_slug_updates(t):
    return changes.apply_slugs(t.devices, changes.slug_results(t.slug_requests, t.devices))


@query
def K6_backfill(t):
    return changes.backfill_keys(t.devices, KEY_SEED)


@query
def K6_added_column(t):
    return changes.backfill_keys(t.devices.drop("secret_key"), KEY_SEED)


# Streams: the given tables read as streams until their end, then the stored result

class StreamTables(TestTables):
    """The logical tables over streaming reads of the given ones."""

    def raw(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return (self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
                .parquet(self.folder))


def ingested(t: TestTables, conn_type: str = "device") -> jobs.IngestStore:
    """Run the ingest job over all messages."""
    store = jobs.IngestStore(t.spark, new_path(t.spark, "ingest"))
    messages = StreamTables(t.spark, t.folder).messages
    work = jobs.ingest_batch(store, lambda: (t.devices, t.connections), conn_type)
    jobs.run(messages, work, f"{store.folder}/checkpoint", trigger=None).awaitTermination()
    return store


@query
def T1_ingest_stream(t):
    return ingested(t).readings.read().drop("day")


@query
def T1_ingest_replies(t):
    return ingested(t).replies.read().drop("frame")


@query
def T6_live_series_stream(t):
    rows = ingested(t).live_series().select("device_id", "sensor_type", F.posexplode(
        F.arrays_zip("labels", "values")))
    return rows.select("device_id", "sensor_type", F.col("pos").cast("long").alias("pos"),
                       F.col("col.labels").alias("label"), F.col("col.values").alias("value"))


@query
def K1_history_sink(t):
    """The history as Spark's file sink appends it."""
    folder = new_path(t.spark, "history")
    jobs.history_job(StreamTables(t.spark, t.folder).messages, t.devices, f"{folder}/readings", f"{folder}/checkpoint",
                     trigger=None).awaitTermination()
    return jobs.read_history(t.spark, f"{folder}/readings").drop("day")


@query
def T2_shared_store(t):
    """Device and dashboard messages as two streams into one store: all stored readings."""
    store = ingested(t)
    owned = ingest.authenticate(StreamTables(t.spark, t.folder).messages, tables.registry(t.devices)).where("accepted")
    work = jobs.ingest_batch(store, lambda: (t.devices, t.connections), "dashboard")
    jobs.run(owned.select("msg_id", "ts", "user_id", "raw"), work, f"{store.folder}/dashboards", trigger=None).awaitTermination()
    return store.readings.read().drop("day")


@query
def S2_message_lines(t):
    """The messages written as JSON lines and ingested a few files at a time."""
    folder = new_path(t.spark, "lines")
    t.messages.repartitionByRange(8, "msg_id").write.options(**sinks.TIMES).json(f"{folder}/messages")
    store = jobs.IngestStore(t.spark, f"{folder}/store")
    work = jobs.ingest_batch(store, lambda: (t.devices, t.connections))
    jobs.run(tables.stream_messages(t.spark, f"{folder}/messages", max_files=3), work, f"{folder}/checkpoint",
             trigger=None).awaitTermination()
    return store.readings.read().drop("day")


@query
def T9_delete_stream(t):
    """Delete requests as a stream: deleted devices, closed connections and revoked keys."""
    folder = new_path(t.spark, "deletes")
    stream, moment = StreamTables(t.spark, t.folder), now(t)
    requests = stream.delete_requests.withColumn("ts", F.lit(moment).cast("timestamp_ntz"))
    deleted, closes, revoked = (BatchTable(t.spark, f"{folder}/{name}", schema) for name, schema in (
        ("deleted", jobs.DELETED), ("closes", jobs.CLOSES), ("revoked", jobs.REVOKED)))
    jobs.delete_job(requests, lambda: t.devices, lambda: t.connections, deleted, closes, f"{folder}/checkpoint",
                    trigger=None, revoked=revoked).awaitTermination()
    nothing = F.lit(None).cast("string")
    return (deleted.read().select(F.lit("deleted").alias("kind"), "device_id", nothing.alias("detail"))
            .unionByName(closes.read().select(F.lit("close").alias("kind"), "device_id", F.col("conn_key").cast("string").alias("detail")))
            .unionByName(revoked.read().select(F.lit("revoked").alias("kind"), "device_id", F.col("secret_key").alias("detail"))))


@query
def T4_timer_stream(t):
    """Verdicts as timers give them; a last row moves the clock past every limit."""
    folder, stream = new_path(t.spark, "timers"), StreamTables(t.spark, t.folder)
    attempts = conns.auth_attempts(stream.handshakes, tables.registry(t.devices))
    end = stream.raw("region").where("r_regionkey = 0").select(
        F.lit(-1).cast("long").alias("conn_key"), F.lit(now(t)).cast("timestamp").alias("ts"), F.lit("clock").alias("event"))
    events = handshake.decisive_events(stream.handshakes.select("conn_key", "opened_at"), attempts).unionByName(end)
    verdicts = handshake.handshake_verdict_stream(events)
    handshake.write_verdicts(verdicts, f"{folder}/verdicts", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/verdicts").select("conn_key", "verdict", F.col("decided_at").cast("timestamp_ntz").alias("decided_at"))


@query
def K7_export_files(t):
    """Exports of all devices written as CSV and read back, with each row's place in its device's export."""
    folder = new_path(t.spark, "exports")
    sinks.write_exports(history.device_export(t.readings, t.devices), folder, buckets=16)
    return sinks.read_exports(t.spark, folder)


@query
def O1_history_order(t):
    """Recent history with each row's place in the order of the result."""
    return positions(history.owner_history(t.readings, t.devices, now(t)), name="position").select("data_id", "position")


@query
def O2_export_order(t):
    """The export of all devices with each row's place in the order of the result."""
    return positions(history.device_export(t.readings, t.devices), name="position").select("data_id", "position")


@query
def T7_current_values_stream(t):
    folder = new_path(t.spark, "current")
    table = BatchTable(t.spark, f"{folder}/values", jobs.READING)
    jobs.current_value_job(StreamTables(t.spark, t.folder).readings, table, f"{folder}/checkpoint",
                           trigger=None).awaitTermination()
    return state.current_values(table.read())


@query
def T5_connection_stream(t):
    folder = new_path(t.spark, "connections")
    table = BatchTable(t.spark, f"{folder}/steps", jobs.STEPS)
    stream = StreamTables(t.spark, t.folder)
    stream.devices = t.devices
    jobs.connection_job(tables.connection_events(stream.connections), table, f"{folder}/checkpoint",
                        trigger=None).awaitTermination()
    return conns.connection_state(conns.reduce_connection_steps(table.read()))


@query
def T4_handshake_stream(t):
    """Openings and first messages as one stream; verdicts at the end of the data."""
    folder = new_path(t.spark, "handshakes")
    table = BatchTable(t.spark, f"{folder}/steps", jobs.HANDSHAKE)
    rows = StreamTables(t.spark, t.folder).handshakes
    jobs.handshake_job(rows, lambda: tables.registry(t.devices), table, f"{folder}/checkpoint",
                       trigger=None).awaitTermination()
    return conns.handshake_verdicts(conns.reduce_handshake_steps(table.read()), now(t))
