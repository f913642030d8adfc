"""Telemetry analytics on Spark: history, current state, routing and ingest of device readings."""
