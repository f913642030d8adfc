"""What each widget shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.payload import compute_once
from tidemark.functions.scalars import first_filled, is_on, leading_integer, toggle_label
from tidemark.operators.state import SENSOR

# Bounds of a slider and full scale of a gauge.
SLIDER_MIN, SLIDER_MAX, GAUGE_FULL = 0, 255, 100


def widget_display(widgets: DataFrame, recent_values: DataFrame) -> DataFrame:
    """Display values per widget from its current value.

    ``recent_values`` holds the newest reading per sensor of the recent window; only text widgets
    fall back to it, and only when their current value is empty.
    """
    newest = recent_values.select(*SENSOR, F.col("value").alias("_newest"))
    kind, current, number = F.col("widget_type"), F.col("current_value"), F.col("_number")
    numbered = compute_once(widgets, {"_number": F.when(kind.isin("slider", "gauge"), leading_integer(current))})
    plain = ~kind.isin("graph", "toggle", "slider", "gauge")
    shown = (F.when(kind == "toggle", toggle_label(current))
             .when(kind.isin("slider", "gauge"), number.cast("string"))
             .when(kind == "graph", first_filled(current))
             .otherwise(first_filled(current, F.col("_newest"))))
    return (numbered.join(newest, SENSOR, "left")
            .select("widget_id", "device_id", "sensor_type", "widget_type", "data_type",
                    shown.alias("shown"), plain.alias("is_text"),
                    F.when(kind == "toggle", is_on(current)).alias("is_on"),
                    F.when(kind == "gauge", number).alias("gauge_value"),
                    F.when(kind == "gauge", F.lit(GAUGE_FULL) - number).alias("gauge_rest"),
                    F.when(kind == "slider", number).alias("slider_value"),
                    F.when(kind == "slider", F.lit(SLIDER_MIN)).alias("slider_min"),
                    F.when(kind == "slider", F.lit(SLIDER_MAX)).alias("slider_max")))
