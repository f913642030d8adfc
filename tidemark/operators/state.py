"""Current values per sensor and what the widgets show of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

SENSOR = ["device_id", "sensor_type"]


def current_values(readings: DataFrame) -> DataFrame:
    """Latest reading per sensor; ties on time go to the larger id.

    One aggregate with a map-side part: each task sends one row per sensor, however many
    readings a chatty sensor has.
    """
    return (readings.groupBy(*SENSOR)
            .agg(F.max_by(F.struct("value", "ts", "data_id"), F.struct("ts", "data_id")).alias("_last"))
            .select(*SENSOR, "_last.value", "_last.ts", "_last.data_id"))


def update_widgets(widgets: DataFrame, latest: DataFrame) -> DataFrame:
    """New widget snapshot: each widget of an updated sensor takes its latest value.

    A latest value of null is a value, so a match is told from no match by the id.
    """
    news = latest.select(*SENSOR, F.col("value").alias("_value"), F.col("data_id").alias("_id"))
    kept = [c for c in widgets.columns if c != "current_value"]
    return (widgets.join(news, SENSOR, "left")
            .select(*kept, F.when(F.col("_id").isNotNull(), F.col("_value"))
                    .otherwise(F.col("current_value")).alias("current_value")))


def visible_widgets(widgets: DataFrame) -> DataFrame:
    """The one widget per sensor that gets a place on the page: the first created.

    The rank limit is applied before the shuffle, so many widgets on one sensor do not meet in one task.
    """
    first = Window.partitionBy(*SENSOR).orderBy("widget_id")
    return (widgets.withColumn("_rank", F.row_number().over(first))
            .where(F.col("_rank") <= 1).drop("_rank"))
