"""Series of readings per sensor and per widget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalars import time_label
from tidemark.operators.state import SENSOR

LIVE_POINTS = 40  # Fixed value: points a live chart keeps.


def last_points(readings: DataFrame, n: int = LIVE_POINTS) -> DataFrame:
    """The newest ``n`` readings of every sensor, numbered from the newest.

    Spark limits the rank inside each input task first, so at most ``n`` rows per sensor and task
    are shuffled.
    """
    newest = Window.partitionBy(*SENSOR).orderBy(F.desc("ts"), F.desc("data_id"))
    return readings.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n)


def live_series(readings: DataFrame, n: int = LIVE_POINTS) -> DataFrame:
    """One row per sensor with its last ``n`` labels and values, oldest first."""
    points = F.sort_array(F.collect_list(F.struct("ts", "data_id", "value")))
    return (last_points(readings, n).groupBy(*SENSOR).agg(points.alias("_points"))
            .select(*SENSOR,
                    F.transform("_points", lambda p: time_label(p["ts"])).alias("labels"),
                    F.transform("_points", lambda p: p["value"]).alias("values")))


def in_chunks(rows: DataFrame, order: list[str], chunk_bits: int = 10) -> DataFrame:
    """Sort rows by ``order`` across the cluster and add ``chunk``, a number per run of rows.

    Range partitioning balances by measured row counts, so a key that holds a third of all rows
    spreads over a third of the partitions. Row numbers of a partition start at a multiple of 2^33,
    so a chunk never spans partitions and never exceeds 2^chunk_bits rows. Chunk numbers grow with ``order``.
    """
    return (rows.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), chunk_bits)))


def series_chunks(readings: DataFrame, chunk_bits: int = 10) -> DataFrame:
    """The whole series of every sensor as ordered chunks of labels and values.

    A series has as many chunks as it needs, so nothing is dropped and no array grows with it.
    """
    points = F.sort_array(F.collect_list(F.struct("ts", "data_id", "value")))
    return (in_chunks(readings, [*SENSOR, "ts", "data_id"], chunk_bits)
            .groupBy(*SENSOR, "chunk").agg(points.alias("points"))
            .select(*SENSOR, "chunk", "points",
                    F.transform("points", lambda p: time_label(p["ts"])).alias("labels"),
                    F.transform("points", lambda p: p["value"]).alias("values")))


def widget_series(widgets: DataFrame, readings: DataFrame, chunk_bits: int = 10) -> DataFrame:
    """Series chunks of every graph widget."""
    graphs = widgets.where(F.col("widget_type") == "graph").select("widget_id", *SENSOR)
    shown = readings.join(graphs.select(*SENSOR).distinct(), SENSOR, "left_semi")  # before sorting and collecting
    return series_chunks(shown, chunk_bits).join(graphs, SENSOR)


def widget_readings(widgets: DataFrame, readings: DataFrame) -> DataFrame:
    """Every widget with the readings of its sensor; widgets without readings stay, once.

    Two parts instead of one outer join: the inner join may broadcast the widgets or split a hot
    sensor, which an outer join that preserves the widgets cannot; the rest needs only the distinct sensors.
    """
    points = readings.select(*SENSOR, "data_id", "value", "ts")
    filled = widgets.join(points, SENSOR)
    silent = widgets.join(readings.select(*SENSOR).distinct(), SENSOR, "left_anti")
    columns = ["widget_id", *SENSOR, "widget_type", "data_id", "value", "ts"]
    return filled.select(*columns).unionByName(silent.select(*columns[:4]), allowMissingColumns=True)
