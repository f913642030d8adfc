"""Readers for tables, message streams and the test inputs."""
