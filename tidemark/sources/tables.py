"""Batch and streaming readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.schemas import MESSAGES, TABLES


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One logical table from parquet, with its fixed schema and no inference."""
    return spark.read.schema(TABLES[table]).parquet(path)


def stream_table(spark: SparkSession, path: str, table: str, max_files: int | None = None) -> DataFrame:
    """The streaming twin of :func:`read_table`."""
    reader = spark.readStream.schema(TABLES[table])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages from JSON-lines files; ``raw`` keeps the payload text untouched."""
    return spark.read.schema(MESSAGES).json(path)


def stream_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(MESSAGES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def stream_kafka_messages(spark: SparkSession, servers: str, topic: str,
                          max_offsets: int | None = None) -> DataFrame:
    """Messages from Kafka: record key = device secret, value = payload text.

    Needs the Kafka connector on the class path. The message id packs partition and offset,
    so it is unique, stable on replay and ordered within a partition.
    """
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", servers).option("subscribe", topic))
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.shiftleft(F.col("partition").cast("long"), 48).bitwiseOR(F.col("offset")).alias("msg_id"),
        F.col("timestamp").cast("timestamp_ntz").alias("ts"),
        F.col("key").cast("string").alias("secret_key"),
        F.col("value").cast("string").alias("raw"))


def registry(devices: DataFrame) -> DataFrame:
    """Secret key -> device. Devices without a key cannot authenticate and are left out."""
    return (devices.where(F.col("secret_key") != "")
            .select("secret_key", "device_id", "device_name", "user_id"))


def missing_key(devices: DataFrame) -> DataFrame:
    """Devices whose secret key is null or empty."""
    return devices.where(F.col("secret_key").isNull() | (F.col("secret_key") == ""))


def connection_events(connections: DataFrame) -> DataFrame:
    """Lifecycle rows (open, auth, close) of connections, one row per step that happened."""
    steps = F.array(
        F.struct(F.lit("open").alias("event"), F.col("opened_at").alias("ts")),
        F.struct(F.lit("auth").alias("event"), F.col("auth_at").alias("ts")),
        F.struct(F.lit("close").alias("event"), F.col("closed_at").alias("ts")))
    return (connections.select("conn_key", F.inline(steps))
            .where(F.col("ts").isNotNull()))
