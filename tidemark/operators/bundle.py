"""Page bundles: device, widgets and recent readings of shared pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.history import recent
from tidemark.operators.series import in_chunks


def bundle_rows(pages: DataFrame, widgets: DataFrame, readings: DataFrame, as_of: datetime,
                mode: str = "reference") -> DataFrame:
    """Flat bundle: one row per device, per widget and per recent reading of the requested pages.

    ``pages`` holds (device_id, device_name) of the resolved requests; each page is built once
    however many requests name it.
    """
    wanted = pages.where(F.col("device_id").isNotNull()).select("device_id", "device_name").distinct()
    head = wanted.select("device_id", F.lit("device").alias("part"), F.lit(0).cast("long").alias("item_id"),
                         "device_name")
    # Inner joins on one row per device: the page side may be broadcast, and a hot device can be split.
    controls = widgets.join(wanted.select("device_id"), "device_id").select(
        "device_id", F.lit("widget").alias("part"), F.col("widget_id").alias("item_id"),
        "sensor_type", "widget_type", "data_type", "current_value")
    points = recent(readings, as_of, mode).join(wanted.select("device_id"), "device_id").select(
        "device_id", F.lit("reading").alias("part"), F.col("data_id").alias("item_id"),
        "sensor_type", "value", "ts")
    return (head.unionByName(controls, allowMissingColumns=True)
            .unionByName(points, allowMissingColumns=True))


def bundle_chunks(rows: DataFrame, chunk_bits: int = 10) -> DataFrame:
    """Bundle parts as JSON-ready arrays of at most 2^chunk_bits items, in page order.

    The items of a device are the concatenation of its chunks; readings are ordered by time.
    """
    ordered = in_chunks(rows, ["device_id", "part", "ts", "item_id"], chunk_bits)
    items = F.sort_array(F.collect_list(F.struct(
        "ts", "item_id", "device_name", "sensor_type", "widget_type", "data_type", "current_value", "value")))
    return ordered.groupBy("device_id", "part", "chunk").agg(items.alias("items"))


def bundle_json(chunks: DataFrame) -> DataFrame:
    """The chunks with their items encoded for a sink."""
    return chunks.select("device_id", "part", "chunk", F.to_json("items").alias("items"))
