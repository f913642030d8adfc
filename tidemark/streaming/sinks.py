"""Exports and queue records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators.numbering import number_rows

# Times keep their microseconds; the default of the writer is milliseconds.
TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CSV_OPTIONS = {"header": True, **TIMES}


def write_export(rows: DataFrame, path: str) -> None:
    """Export of one device as CSV with a header, newest first across the numbered files; ties by data_id."""
    (rows.orderBy(F.desc("ts"), F.desc("data_id")).select("ts", "sensor_type", "value")
     .write.mode("overwrite").options(**CSV_OPTIONS).csv(path))


def write_exports(rows: DataFrame, path: str, buckets: int = 256) -> None:
    """Exports of many devices as CSV, newest first per device.

    Devices share bucket folders, so there are few folders however many devices. Range partitioning by
    device and time splits a hot device over several files, in time order.
    """
    (rows.withColumn("bucket", F.pmod(F.xxhash64("device_id"), F.lit(buckets)))
     .repartitionByRange("bucket", "device_id", F.desc("ts"), F.desc("data_id"))
     .sortWithinPartitions("bucket", "device_id", F.desc("ts"), F.desc("data_id"))
     .select("bucket", "device_id", "ts", "sensor_type", "value")
     .write.mode("overwrite").partitionBy("bucket").options(**CSV_OPTIONS).csv(path))


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """The files of :func:`write_exports`: device_id, ts, sensor_type, value, and ``position``, the row's place in its
    device's export as the files hold it, file by file and line by line, 1 being the first."""
    # An unquoted empty field is null, a quoted one the empty text; the reader tells them apart only by a null mark.
    rows = (spark.read.options(**CSV_OPTIONS, nullValue="\x01")
            .schema("device_id long, ts timestamp_ntz, sensor_type string, value string, bucket int").csv(path)
            .select("bucket", "device_id", "ts", "sensor_type", "value", F.col("_metadata.file_name").alias("_file"),
                    F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")))
    order = ["bucket", "device_id", "_file", "_block", "_line"]
    first = F.min("_n").over(Window.partitionBy("device_id"))
    return (number_rows(rows, order, name="_n").withColumn("position", F.col("_n") - first + 1)
            .select("device_id", "ts", "sensor_type", "value", "position"))


def queue_records(records: DataFrame, parts: int = 32) -> DataFrame:
    """Outbox records as key and value of a message queue; records of an audience share a key.

    The audience ``devices`` hears every device, so it is spread over ``parts`` keys, ``devices:0`` and on; a
    listener reads them all. The updates of one device share a key, so their order holds.
    """
    part = F.pmod(F.xxhash64(F.get_json_object("payload", "$.device_id")), F.lit(parts)).cast("string")
    key = F.when(F.col("audience") == "devices", F.concat(F.lit("devices:"), part)).otherwise(F.col("audience"))
    return records.select(key.alias("key"), F.col("payload").alias("value"),
                          F.array(F.struct(F.lit("skip_conn_key").alias("key"),
                                           F.col("skip_conn_key").cast("string").cast("binary").alias("value")))
                          .alias("headers"))
