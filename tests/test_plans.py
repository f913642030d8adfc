"""Physical plans: what is pushed down, what is never used, and results without broadcasts."""

import re

import pytest

from compare import difference, oracle
from tidemark.plans.oracle import ORACLE
from tidemark.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
BATCH = [n for n in QUERIES if not n.endswith("_stream") and n != "T1_ingest_replies"]


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_history_prunes_at_the_scan(spark):
    text = plan(spark, "J1_readings_24h")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,2024-01-29", text)
    assert "BroadcastHashJoin" in text and "props" not in text


def test_last_points_are_limited_before_the_shuffle(spark):
    text = plan(spark, "W1_last_40_points")
    assert text.index("Final") < text.index("Exchange hashpartitioning") < text.index("Partial")


def test_current_values_are_reduced_before_the_shuffle(spark):
    text = plan(spark, "A1_current_values")
    assert text.index("Exchange hashpartitioning") < text.index("partial_max_by")


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_pair_joins(spark, name):
    text = plan(spark, name)
    for node in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


NO_BROADCAST = ["J1_readings_24h", "J4_public_lookup", "J13_widget_readings", "A5_bundle_rows", "T8_replies",
                "A3_delivery_counts", "J10_device_recipients", "K5_slug_updates", "T4_handshake_replies"]


@pytest.mark.parametrize("name", NO_BROADCAST)
def test_same_rows_when_nothing_is_small_enough_to_broadcast(spark, name):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1kb"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        frame = QUERIES[name](spark, FOLDER)
        assert difference(frame, oracle(FOLDER), ORACLE[name]) == ""
        final = frame._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in final
    finally:
        for key in settings:
            spark.conf.unset(key)
