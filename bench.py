"""Headline queries at one scale; prints one JSON line.

Reads BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]. Every query runs to a no-op sink: once to warm up,
then BENCH_RUNS times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans.queries import QUERIES
from tidemark.session import RECOMMENDED, local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "J1_readings_24h", "J2_device_export", "A1_current_values", "K2_widget_snapshot", "W1_last_40_points",
    "J13_widget_readings", "A4_series_rows", "A5_bundle_rows", "D1_widget_display", "M1_normalised_messages",
    "T1_device_outcomes", "J11_command_acks", "T8_replies", "K8_outbox", "J9_dashboard_recipients",
    "J10_device_recipients", "A3_delivery_counts", "T4_handshake", "T5_connection_state", "V1_registrations",
    "K3_inserted_widgets", "K5_slug_updates", "T1_ingest_stream",
]


def seconds(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, "bench")
    took = {}
    for name in HEADLINE:
        seconds(spark, name)
        took[name] = round(statistics.median(seconds(spark, name) for _ in range(RUNS)), 3)
    events = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
        "ingest_rows_per_sec": round(events / took["T1_ingest_stream"]),
        "settings": {"cpus": CPUS, "runs": RUNS, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                     **RECOMMENDED}}))


if __name__ == "__main__":
    main()
