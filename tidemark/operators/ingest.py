"""From raw messages to readings, updates, commands and replies. Used by batch queries and streams alike."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.payload import compute_once
from tidemark.functions.scalars import as_id, iso_millis
from tidemark.operators.joins import lookup
from tidemark.operators.routing import JSON_OPTIONS, OFFLINE_NOTE, ack_value, with_instances

# Texts of replies.
RECEIVED = "Data berhasil diterima"
CROSS_DEVICE = "Tidak diizinkan mengontrol device lain"
BAD_FORMAT = "Format pesan tidak valid"


def authenticate(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """Add the sending device and its owner; ``accepted`` is false for an unknown key.

    Messages are the preserved side, so a hot key can be split however large the registry is. Further
    columns of the registry, such as the device's connection, come along.
    """
    known = registry.withColumnRenamed("device_id", "auth_device_id")
    return (lookup(messages, known, "secret_key", "msg_id")
            .withColumn("accepted", F.col("auth_device_id").isNotNull()))


def device_outcomes(authenticated: DataFrame) -> DataFrame:
    """Decide about every message on a device connection.

    ``authenticated`` holds the payload fields and the sender. Payloads are read before the sender is
    looked up, so that work is spread as the messages arrive, whoever sends most of them.
    ``outcome``: ``unauthenticated``, ``malformed`` and ``invalid`` (dropped without a reply),
    ``cross_device`` (refused), ``command`` or ``data``. A command may address only the sending device.
    """
    fields = authenticated.withColumn(
        "target_text", F.coalesce("target_text", F.col("auth_device_id").cast("string")))
    own = F.col("target_text") == F.col("auth_device_id").cast("string")
    outcome = (F.when(~F.col("accepted"), "unauthenticated")
               .when(~F.col("is_json"), "malformed")
               .when(~F.col("name_ok") | ~F.col("value_present"), "invalid")
               .when(F.col("is_command") & ~own, "cross_device")
               .when(F.col("is_command"), "command").otherwise("data"))
    return compute_once(fields, {"outcome": outcome, "target_id": as_id(F.col("target_text"))})


def dashboard_outcomes(fields: DataFrame) -> DataFrame:
    """Decide about every message on a dashboard connection: ``malformed``, ``invalid`` or ``command``.

    ``fields`` holds the payload fields and the dashboard's user_id. The addressed device need not exist
    or belong to the user.
    """
    valid = F.col("target_truthy") & F.col("name_ok") & F.col("value_present")
    outcome = F.when(~F.col("is_json"), "malformed").when(~valid, "invalid").otherwise("command")
    return compute_once(fields, {"outcome": outcome, "target_id": as_id(F.col("target_text"))})


def with_ownership(outcomes: DataFrame, devices: DataFrame) -> DataFrame:
    """Mark commands to a device of the commanding user."""
    owned = devices.select(F.col("device_id").alias("target_id"), F.col("user_id").alias("_owner"))
    return (lookup(outcomes, owned, "target_id", "msg_id")
            .withColumn("is_owner", F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False))).drop("_owner"))


def new_values(outcomes: DataFrame) -> DataFrame:
    """Accepted values by device: commands and readings, null values included."""
    return (outcomes.where(F.col("outcome").isin("command", "data") & F.col("target_id").isNotNull())
            .select((F.col("msg_id") + 1).alias("data_id"), F.col("target_id").alias("device_id"),
                    "sensor_type", "value", "ts"))


def new_readings(outcomes: DataFrame) -> DataFrame:
    """Rows to store. A null value is acknowledged and shown but not stored.

    Ids follow the message ids: unique, in arrival order and the same on replay, but with gaps.
    """
    return new_values(outcomes).where(F.col("value").isNotNull())


def stray_values(outcomes: DataFrame) -> DataFrame:
    """Accepted values for a device id that is no number, so of no registered device, kept with the id as it came."""
    return (outcomes.where(F.col("outcome").isin("command", "data") & F.col("target_id").isNull() & F.col("value").isNotNull())
            .select((F.col("msg_id") + 1).alias("data_id"), F.col("target_text").alias("device_text"), "sensor_type", "value", "ts"))


def new_updates(outcomes: DataFrame) -> DataFrame:
    """Updates to send out, with the kind that decides who is told."""
    return (outcomes.where(F.col("outcome").isin("command", "data") & F.col("target_id").isNotNull())
            .select(F.col("msg_id").alias("update_id"), F.col("target_id").alias("device_id"), "sensor_type",
                    "value", "payload_value", "ts", F.col("outcome").alias("kind"), "sender_key"))


def new_commands(outcomes: DataFrame) -> DataFrame:
    """Accepted commands, with the sender and the receiving connections if these are known."""
    senders = [c for c in ("sender_key", "n_sent") if c in outcomes.columns]
    return outcomes.where(F.col("outcome") == "command").select(
        "msg_id", "target_id", "target_text", "sensor_type", "value", "payload_value", *senders)


def replies(outcomes: DataFrame, connections: DataFrame | None = None, as_of: datetime | None = None) -> DataFrame:
    """Everything sent back to senders: data acks, command acks and errors, in one pass.

    Malformed, invalid device and unauthenticated messages get no reply. ``connections`` and ``as_of`` as in
    ``routing.with_instances``: without them each command is judged by the connections open at its own time.
    """
    outcome = F.col("outcome")
    data, command = outcome == "data", outcome == "command"
    refused = (outcome == "invalid") & (F.col("conn_type") == "dashboard")
    answered = outcomes.where(data | command | refused | (outcome == "cross_device"))
    # Only commands need the connections of their target.
    keyed = answered.withColumns({"sender_key": F.when(command, F.col("sender_key")),
                                  "target_id": F.when(command, F.col("target_id"))})
    online = F.col("n_sent") > 0
    accepted = data | command
    return with_instances(keyed, connections, as_of).select(
        "msg_id", F.when(accepted, "ack").otherwise("error").alias("status"),
        F.when(data, "dataReceived").alias("type"),
        F.when(command, F.col("target_text")).alias("device_id"),
        F.when(accepted, F.col("sensor_type")).alias("var"),
        F.when(data, F.col("value")).when(command, ack_value(online)).alias("val"),
        F.when(accepted, F.col("payload_value")).alias("payload_value"),
        F.when(data, iso_millis(F.col("ts"))).alias("timestamp"),
        F.when(data, RECEIVED).when(outcome == "cross_device", CROSS_DEVICE).when(refused, BAD_FORMAT)
         .when(~online, OFFLINE_NOTE).alias("message"))


def reply_frames(reply_rows: DataFrame) -> DataFrame:
    """Add the reply encoded as the client reads it; data acks use the long field names.

    A value is sent back in its own JSON type, except that a delivered command's value is text.
    """
    error = F.struct("status", "message")
    received = F.struct("status", "type", F.col("var").alias("sensor_type"),
                        F.col("payload_value").alias("value"), "timestamp", "message")
    stored = F.struct("status", "device_id", "var", F.col("payload_value").alias("val"), "message")
    sent = F.struct("status", "device_id", "var", "val")
    frame = (F.when(F.col("status") == "error", F.to_json(error))
             .when(F.col("type") == "dataReceived", F.to_json(received, JSON_OPTIONS))
             .when(F.col("message").isNotNull(), F.to_json(stored, JSON_OPTIONS))
             .otherwise(F.to_json(sent, JSON_OPTIONS)))
    return reply_rows.withColumn("frame", frame)
