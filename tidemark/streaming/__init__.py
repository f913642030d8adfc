"""Structured Streaming jobs: ingest, live state and handshakes."""
