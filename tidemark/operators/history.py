"""Readings joined with their devices, and the lookups around them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType

from tidemark.functions.scalars import page_slug
from tidemark.operators.joins import lookup


def latest_time(readings: DataFrame) -> datetime:
    """Time of the newest reading: one aggregated row."""
    return readings.agg(F.max("ts").alias("ts")).first()["ts"]


def cutoff(as_of: datetime, mode: str = "reference") -> datetime:
    """Start of the recent window.

    ``reference`` keeps the whole UTC day the cutoff falls on, so the window spans 24 to 48
    hours; ``exact`` is 24 hours.
    """
    start = as_of - timedelta(days=1)
    if mode == "reference":
        return start.replace(hour=0, minute=0, second=0, microsecond=0)
    if mode == "exact":
        return start
    raise ValueError(f"unknown window mode: {mode}")


def time_literal(rows: DataFrame, moment: datetime, ts: str = "ts") -> Column:
    """A literal of the column's own type, so that the comparison reaches the file scan."""
    ntz = isinstance(rows.schema[ts].dataType, TimestampNTZType)
    kind, zone = ("TIMESTAMP_NTZ", "") if ntz else ("TIMESTAMP", "Z")
    return F.expr(f"{kind} '{moment.isoformat(sep=' ')}{zone}'")


def recent(readings: DataFrame, as_of: datetime, mode: str = "reference") -> DataFrame:
    """Readings since the cutoff; where the table has day folders, older ones are not read."""
    since = cutoff(as_of, mode)
    if "day" in readings.columns:
        readings = readings.where(F.col("day") >= F.lit(since.date()))
    return readings.where(F.col("ts") >= time_literal(readings, since))


def _only(rows: DataFrame, **values) -> DataFrame:
    """Keep rows whose columns equal the given values; None means no restriction."""
    for column, value in values.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def owner_history(readings: DataFrame, devices: DataFrame, as_of: datetime,
                  mode: str = "reference", user_id: int | None = None) -> DataFrame:
    """Recent readings of every owner's devices (or of one owner), oldest first."""
    owned = _only(devices, user_id=user_id).select("device_id", "device_name", "user_id")
    return (recent(readings, as_of, mode).join(owned, "device_id")
            .select("user_id", "device_id", "device_name", "sensor_type", "value", "ts", "data_id")
            .orderBy("ts", "data_id"))


def device_history(readings: DataFrame, as_of: datetime, mode: str = "reference",
                   device_id: int | None = None) -> DataFrame:
    """Recent readings by device, without an owner check."""
    return _only(recent(readings, as_of, mode), device_id=device_id).orderBy("ts", "data_id")


def device_export(readings: DataFrame, devices: DataFrame, device_id: int | None = None,
                  user_id: int | None = None) -> DataFrame:
    """All readings of owned devices, newest first: the rows of the per-device export."""
    owned = _only(devices, device_id=device_id, user_id=user_id).select("device_id", "user_id")
    return (_only(readings, device_id=device_id).join(owned, "device_id")
            .select("user_id", "device_id", "ts", "sensor_type", "value", "data_id")
            .orderBy(F.desc("ts"), F.desc("data_id")))


def requested_exports(requests: DataFrame, readings: DataFrame, devices: DataFrame) -> DataFrame:
    """Exports for many (device_id, user_id) requests; a request by a stranger yields no rows.

    Equal requests are answered once, so a hot device is joined once however often it is asked for.
    """
    granted = (requests.select("device_id", "user_id").distinct()
               .join(devices.select("device_id", "user_id"), ["device_id", "user_id"]))
    return (readings.join(granted, "device_id")
            .select("user_id", "device_id", "ts", "sensor_type", "value", "data_id"))


def widgets_with_device(widgets: DataFrame, devices: DataFrame, user_id: int | None = None) -> DataFrame:
    """Widgets and their device's name. The owner filter is on the widget, not on the device."""
    return (_only(widgets, user_id=user_id)
            .join(devices.select("device_id", "device_name"), "device_id")
            .select("user_id", "widget_id", "device_id", "sensor_type", "widget_type", "data_type",
                    "current_value", "device_name"))


def devices_of(devices: DataFrame, user_id: int | None = None) -> DataFrame:
    return _only(devices, user_id=user_id).select("user_id", "device_id", "device_name", "secret_key")


def user_by_name(users: DataFrame, username: str) -> DataFrame:
    return users.where(F.col("username") == F.lit(username))


def widgets_of_device(widgets: DataFrame, device_id: int | None = None) -> DataFrame:
    return _only(widgets, device_id=device_id).select(
        "device_id", "widget_id", "sensor_type", "widget_type", "data_type", "current_value")


def public_lookup(requests: DataFrame, users: DataFrame, devices: DataFrame) -> DataFrame:
    """Resolve (username, device_name) requests to the smallest matching device id.

    Status 400 for an empty field, 404 without a match, else 200. The first match is a minimum,
    so a name shared by many devices is reduced before it is shuffled.
    """
    named = (devices.join(users.select("user_id", "username"), "user_id")
             .groupBy("username", "device_name").agg(F.min("device_id").alias("device_id")))
    filled = (F.coalesce(F.col("username"), F.lit("")) != "") & (F.coalesce(F.col("device_name"), F.lit("")) != "")
    return (lookup(requests, named, ["username", "device_name"], "request_id")
            .select("request_id", "username", "device_name",
                    F.when(~filled, 400).when(F.col("device_id").isNull(), 404).otherwise(200).alias("status"),
                    F.when(filled, F.col("device_id")).alias("device_id")))


def slug_lookup(requests: DataFrame, devices: DataFrame) -> DataFrame:
    """Resolve page paths by their last segment; unknown slugs get status 404."""
    pages = (devices.where(F.col("public_slug").isNotNull())
             .select(F.col("public_slug").alias("slug"), "device_id", "device_name"))
    return (lookup(requests.withColumn("slug", page_slug(F.col("path"))), pages, "slug", "request_id")
            .select("request_id", "slug", "device_id", "device_name",
                    F.when(F.col("device_id").isNull(), 404).otherwise(200).alias("status")))


def rows_per_owner(readings: DataFrame, devices: DataFrame, users: DataFrame, as_of: datetime,
                   mode: str = "reference") -> DataFrame:
    """Number of recent readings each user would be sent, zero included.

    Readings are counted per device before the join, so only one row per device is shuffled to it.
    """
    per_device = recent(readings, as_of, mode).groupBy("device_id").agg(F.count("*").alias("n"))
    per_user = (per_device.join(devices.select("device_id", "user_id"), "device_id")
                .groupBy("user_id").agg(F.sum("n").alias("n_rows")))
    return (users.select("user_id").join(per_user, "user_id", "left")
            .select("user_id", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows")))
