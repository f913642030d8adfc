"""Who receives an update, and what is sent.

An update is written once per audience (``user:<id>``, ``slug:<slug>`` or ``devices``) with the one
connection it must skip. The receivers of a record are the open subscriptions of its audience except
that connection, so the pair list is never built: its size is updates times connections. Counts per
update, counts per receiver and the rows of any one receiver follow from the two tables.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalars import iso_millis
from tidemark.operators.history import time_literal
from tidemark.operators.joins import lookup

JSON_OPTIONS = {"ignoreNullFields": "false"}


def is_open(connections: DataFrame, as_of: datetime) -> Column:
    """Socket opened and not closed at the given time."""
    now = time_literal(connections, as_of, "opened_at")
    return (F.col("opened_at") <= now) & (F.col("closed_at").isNull() | (F.col("closed_at") > now))


def is_authenticated(connections: DataFrame, as_of: datetime) -> Column:
    return F.coalesce(F.col("auth_at") <= time_literal(connections, as_of, "opened_at"), F.lit(False))


def subscriptions(connections: DataFrame, as_of: datetime) -> DataFrame:
    """Open receivers and the audience each listens to.

    Dashboards listen to their owner's updates, devices to all device updates, public pages to their slug.
    """
    kind = F.col("conn_type")
    audience = (F.when(kind == "dashboard", F.concat(F.lit("user:"), F.col("user_id").cast("string")))
                .when(kind == "device", "devices")
                .when((kind == "public") & (F.col("slug") != ""), F.concat(F.lit("slug:"), F.col("slug"))))
    return (connections
            .where(is_open(connections, as_of)
                   & ((kind == "public") | is_authenticated(connections, as_of)))
            .select("conn_key", "conn_type", "device_id", "user_id", audience.alias("audience"))
            .where(F.col("audience").isNotNull()))


def with_owner(updates: DataFrame, devices: DataFrame) -> DataFrame:
    """Add owner, device name and slug of the device; updates of unknown devices drop out."""
    return updates.join(devices.select("device_id", "user_id", "device_name", "public_slug"), "device_id")


def public_updates(owned: DataFrame) -> DataFrame:
    """Updates of shared devices in the field names of the public page."""
    return (owned.where(F.col("public_slug") != "")
            .select("update_id", "public_slug", F.lit("dataUpdate").alias("type"), "sensor_type",
                    F.col("value").alias("current_value"), iso_millis(F.col("ts")).alias("timestamp")))


def dashboard_updates(owned: DataFrame) -> DataFrame:
    """Updates in the field names of the owner's dashboards."""
    return owned.select("update_id", "user_id", F.col("device_name").alias("device"), "device_id",
                        F.col("sensor_type").alias("var"), F.col("value").alias("val"),
                        iso_millis(F.col("ts")).alias("timestamp"))


def outbox(owned: DataFrame) -> DataFrame:
    """One record per update and audience, with the payload encoded once.

    ``owned`` holds update_id, kind, sender_key and the columns of :func:`with_owner`. Device updates
    are sent for readings only (kind ``data``) and skip the sender's own connection.
    """
    time = iso_millis(F.col("ts")).alias("timestamp")
    body = F.col("payload_value") if "payload_value" in owned.columns else F.col("value")
    nobody = F.lit(None).cast("long")

    def record(audience: Column, skip: Column, payload: Column, when: Column) -> Column:
        return F.when(when, F.struct(audience.alias("audience"), skip.alias("skip_conn_key"),
                                     F.to_json(payload, JSON_OPTIONS).alias("payload")))

    records = F.array(
        record(F.concat(F.lit("user:"), F.col("user_id").cast("string")), nobody,
               F.struct(F.col("device_name").alias("device"), "device_id",
                        F.col("sensor_type").alias("var"), body.alias("val"), time), F.lit(True)),
        record(F.concat(F.lit("slug:"), F.col("public_slug")), nobody,
               F.struct(F.lit("dataUpdate").alias("type"), "sensor_type",
                        body.alias("current_value"), time), F.col("public_slug") != ""),
        record(F.lit("devices"), F.col("sender_key"),
               F.struct(F.lit("dataUpdate").alias("type"), "device_id", "device_name",
                        F.col("sensor_type").alias("var"), body.alias("val"), time), F.col("kind") == "data"))
    return owned.select("update_id", "ts", F.inline(records)).where(F.col("payload").isNotNull())


def delivery_counts(updates: DataFrame, devices: DataFrame, subs: DataFrame) -> DataFrame:
    """Open receivers per update: dashboards of the owner, other devices, public pages.

    Owner and slug counts depend on the device alone, so they are prepared as one row per device and
    the updates are joined once. The number of devices is one value for all.
    """
    per_audience = subs.groupBy("audience").agg(F.count("*").alias("n"))
    of_user = per_audience.select(F.col("audience").alias("_user"), F.col("n").alias("n_dashboards"))
    of_slug = per_audience.select(F.col("audience").alias("_slug"), F.col("n").alias("n_public"))
    zero = F.lit(0).cast("long")
    per_device = (devices.select("device_id",
                                 F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("_user"),
                                 F.concat(F.lit("slug:"), F.nullif("public_slug", F.lit(""))).alias("_slug"))
                  .join(of_user, "_user", "left").join(of_slug, "_slug", "left")
                  .select("device_id", F.coalesce("n_dashboards", zero).alias("n_dashboards"),
                          F.coalesce("n_public", zero).alias("n_public")))
    listeners = subs.where(F.col("audience") == "devices")
    total = listeners.agg(F.count("*").alias("n")).scalar()
    senders = listeners.select(F.col("conn_key").alias("sender_key"), F.lit(1).cast("long").alias("_self"))
    return (lookup(updates.join(per_device, "device_id"), senders, "sender_key", "update_id")
            .select("update_id", "device_id", "n_dashboards",
                    (total - F.coalesce("_self", zero)).alias("n_devices"), "n_public"))


def _summary(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n_updates").alias("n_updates"), F.sum("id_sum").alias("id_sum"))


def _with_sums(updates: DataFrame, *keys: str) -> DataFrame:
    return updates.groupBy(*keys).agg(
        F.count("*").alias("n_updates"), F.sum(F.col("update_id").cast("decimal(28,0)")).alias("id_sum"))


def _received(rows: DataFrame, *columns: str) -> DataFrame:
    """Receivers with what reaches them; both are zero for a receiver nothing is sent to."""
    return rows.select(*columns, F.coalesce("n_updates", F.lit(0).cast("long")).alias("n_updates"),
                       F.coalesce("id_sum", F.lit(0)).cast("decimal(38,0)").cast("string").alias("id_sum"))


def dashboard_receivers(updates: DataFrame, devices: DataFrame, subs: DataFrame) -> DataFrame:
    """Every open dashboard with the number and id sum of its owner's updates.

    Updates are reduced per device, then per owner, before they meet the dashboards.
    """
    per_user = _summary(_with_sums(updates, "device_id").join(devices.select("device_id", "user_id"), "device_id"),
                        "user_id")
    return _received(subs.where(F.col("conn_type") == "dashboard").select("conn_key", "user_id")
                     .join(per_user, "user_id", "left"), "conn_key", "user_id")


def public_receivers(updates: DataFrame, devices: DataFrame, subs: DataFrame) -> DataFrame:
    """Every open public page with the number and id sum of its device's updates."""
    shared = (devices.where(F.col("public_slug") != "")
              .select("device_id", F.concat(F.lit("slug:"), F.col("public_slug")).alias("audience")))
    per_slug = _summary(_with_sums(updates, "device_id").join(shared, "device_id"), "audience")
    return _received(subs.where(F.col("conn_type") == "public").select("conn_key", "audience")
                     .join(per_slug, "audience", "left"), "conn_key", "audience")


def device_receivers(updates: DataFrame, devices: DataFrame, subs: DataFrame,
                     scope: str = "all") -> DataFrame:
    """Every open device connection with the number and id sum of the updates it is sent.

    That is all updates (scope ``all``) or those of its own owner (``owner``), less the ones it sent itself.
    Updates are reduced per device and sender before anything else.
    """
    sent = (_with_sums(updates, "device_id", "sender_key")
            .join(devices.select("device_id", "user_id"), "device_id"))
    listeners = subs.where(F.col("conn_type") == "device").select("conn_key", "user_id")
    sender = ["conn_key", "user_id"] if scope == "owner" else ["conn_key"]
    own = _summary(sent.withColumnRenamed("sender_key", "conn_key"), *sender).select(
        *sender, F.col("n_updates").alias("_own_n"), F.col("id_sum").alias("_own_sum"))
    if scope == "owner":
        offered = listeners.join(_summary(sent, "user_id"), "user_id", "left")
    elif scope == "all":
        totals = sent.agg(F.struct(F.sum("n_updates").alias("n"), F.sum("id_sum").alias("s"))).scalar()
        offered = (listeners.withColumn("_t", totals)
                   .withColumns({"n_updates": F.col("_t.n"), "id_sum": F.col("_t.s")}))
    else:
        raise ValueError(f"unknown scope: {scope}")
    zero = F.lit(0)
    left = (offered.join(own, sender, "left")
            .withColumns({"n_updates": F.col("n_updates") - F.coalesce("_own_n", zero),
                          "id_sum": F.col("id_sum") - F.coalesce("_own_sum", zero)}))
    return _received(left, "conn_key", "user_id")


def feed(records: DataFrame, subs: DataFrame, conn_key: int) -> DataFrame:
    """The outbox records one connection is sent, oldest first."""
    receiver = subs.where(F.col("conn_key") == conn_key).select("conn_key", "audience")
    return (records.join(receiver, "audience")
            .where(~F.col("skip_conn_key").eqNullSafe(F.col("conn_key")))
            .select("update_id", "ts", "audience", "payload").orderBy("ts", "update_id"))


def device_instances(connections: DataFrame, as_of: datetime) -> DataFrame:
    """Authenticated connections per device that are open; a closed connection is gone."""
    return (connections.where((F.col("conn_type") == "device") & is_authenticated(connections, as_of)
                              & is_open(connections, as_of))
            .groupBy("device_id").agg(F.count("*").alias("n_open")))


# Fixed value: note in the reply to a command whose device has no connection.
OFFLINE_NOTE = "Nilai disimpan (device offline)"


def with_instances(commands: DataFrame, connections: DataFrame | None = None, as_of: datetime | None = None) -> DataFrame:
    """Add ``n_sent``, the target's open connections, not counting the sender's own.

    Without ``as_of`` the commands hold it already, as of each one's own time (``presence.with_senders``). With it,
    all are judged by the connections open at that one time: ``commands`` holds msg_id, target_id and sender_key
    (NULL from a dashboard), and connections are counted per device before the join.
    """
    if as_of is None:
        return commands
    instances = device_instances(connections, as_of).withColumnRenamed("device_id", "target_id")
    senders = (connections.where((F.col("conn_type") == "device") & is_authenticated(connections, as_of)
                                 & is_open(connections, as_of))
               .select(F.col("conn_key").alias("sender_key"), F.col("device_id").alias("_sender_device")))
    known = lookup(lookup(commands, instances, "target_id", "msg_id"), senders, "sender_key", "msg_id")
    own = F.col("_sender_device") == F.col("target_id")
    return known.withColumn(
        "n_sent", F.coalesce("n_open", F.lit(0).cast("long")) - F.when(own, 1).otherwise(0)
    ).drop("n_open", "_sender_device")


def ack_value(online: Column) -> Column:
    """Value in a command ack: as text when it was sent, else as it came."""
    return F.when(online, F.coalesce("value", F.lit("null"))).otherwise(F.col("value"))


def command_acks(commands: DataFrame, connections: DataFrame | None = None, as_of: datetime | None = None) -> DataFrame:
    """Reply to every command and the number of device connections it was sent to.

    ``commands`` also holds target_text, sensor_type and value. A device without an open connection
    gets the offline note. For ``connections`` and ``as_of`` see :func:`with_instances`.
    """
    online = F.col("n_sent") > 0
    return with_instances(commands, connections, as_of).select(
        "msg_id", "target_id", F.lit("ack").alias("status"), F.col("target_text").alias("device_id"),
        F.col("sensor_type").alias("var"), ack_value(online).alias("val"),
        F.when(~online, OFFLINE_NOTE).alias("message"), "n_sent")


def command_frames(commands: DataFrame) -> DataFrame:
    """The message a device receives for a command; the value is always text."""
    text = F.coalesce("value", F.lit("null"))
    return commands.select("msg_id", "target_id", F.to_json(F.struct(
        F.lit("command").alias("type"), F.col("sensor_type").alias("var"), text.alias("val"),
        "sensor_type", text.alias("value")), JSON_OPTIONS).alias("payload"))
