"""The running jobs. Each shares its operators with the batch queries."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.storagelevel import StorageLevel

from tidemark.functions.payload import with_fields
from tidemark.operators import connections as conns, history, ingest, presence, routing, series, state
from tidemark.sources import tables
from tidemark.streaming.log import BatchTable

READING = "data_id long, device_id long, sensor_type string, value string, ts timestamp_ntz"
REPLY = ("msg_id long, status string, type string, device_id string, var string, val string, "
         "timestamp string, message string, frame string")
RECORD = "update_id long, ts timestamp_ntz, audience string, skip_conn_key long, payload string"
STRAY = "data_id long, device_text string, sensor_type string, value string, ts timestamp_ntz"
COMMAND = "msg_id long, target_id long, payload string"
STEPS = "conn_key long, open_ts timestamp_ntz, auth_ts timestamp_ntz, close_ts timestamp_ntz"
HANDSHAKE = "conn_key long, opened_at timestamp_ntz, good_ts timestamp_ntz, bad_ts timestamp_ntz"

TRIGGER = "2 seconds"  # Fixed value: longest time a reading waits to be stored.


def run(stream: DataFrame, each_batch: Callable[[DataFrame, int], None], checkpoint: str,
        trigger: str | None = TRIGGER, mode: str = "append") -> StreamingQuery:
    """Start a job; without a trigger interval it processes what is available and ends."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each_batch)
    writer = writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)
    return writer.start()


@dataclass
class IngestStore:
    """Output tables of the ingest job below one folder."""

    spark: SparkSession
    folder: str
    kept_points: int = series.LIVE_POINTS

    def _table(self, name: str, schema: str, *partition_by: str) -> BatchTable:
        return BatchTable(self.spark, f"{self.folder}/{name}", schema, partition_by)

    @cached_property
    def readings(self) -> BatchTable:
        return self._table("readings", READING + ", day date", "day")

    @cached_property
    def strays(self) -> BatchTable:
        """Acknowledged values whose device id is no number."""
        return self._table("strays", STRAY)

    @cached_property
    def latest(self) -> BatchTable:
        return self._table("latest", READING)

    @cached_property
    def points(self) -> BatchTable:
        return self._table("points", READING)

    @cached_property
    def replies(self) -> BatchTable:
        return self._table("replies", REPLY)

    @cached_property
    def outbox(self) -> BatchTable:
        return self._table("outbox", RECORD)

    @cached_property
    def commands(self) -> BatchTable:
        return self._table("commands", COMMAND)

    def current_values(self) -> DataFrame:
        return state.current_values(self.latest.read())

    def live_series(self, n: int = series.LIVE_POINTS) -> DataFrame:
        if n > self.kept_points:
            raise ValueError(f"the store keeps {self.kept_points} points per sensor")
        return series.live_series(self.points.read(), n)

    def compact(self) -> None:
        """Fold the per-batch state; to be run now and then, between batches or by its own job."""
        self.latest.compact(state.current_values)
        self.points.compact(lambda rows: series.last_points(rows, self.kept_points))


def decisions(batch: DataFrame, devices: DataFrame, conn_type: str) -> DataFrame:
    """Outcomes of messages of one kind of connection, which do not depend on who is connected.

    Device messages carry secret_key, dashboard messages user_id. A conn_key column names a device's connection.
    """
    fields = with_fields(batch).drop("raw").withColumn("conn_type", F.lit(conn_type))
    if conn_type == "dashboard":
        return ingest.dashboard_outcomes(fields)
    if "conn_key" in batch.columns:
        fields = fields.withColumnRenamed("conn_key", "sender_key")
    return ingest.device_outcomes(ingest.authenticate(fields, tables.registry(devices)))


def decided(batch: DataFrame, devices: DataFrame, connections: DataFrame, conn_type: str,
            steps: DataFrame | None = None) -> DataFrame:
    """Outcomes with the sender's connection and the number of other open connections of the target.

    Both are as of each message's own time, so they do not depend on how messages are cut into batches. ``steps`` may
    hold rows of ``presence.stored_steps`` that cover the messages.
    """
    outcomes = decisions(batch, devices, conn_type)
    if steps is None:
        steps = presence.stored_steps(connections, *presence.time_span(batch))
    return presence.with_senders(outcomes, steps, connections)


def write_all(batch_id: int, tables_rows: dict[BatchTable, DataFrame], source: str | None = None) -> None:
    """Write several tables of a batch of one source at the same time; the first failure fails the batch."""
    with ThreadPoolExecutor(len(tables_rows)) as pool:
        for done in [pool.submit(table.write, batch_id, rows, source) for table, rows in tables_rows.items()]:
            done.result()


def ingest_batch(store: IngestStore, dimensions: Callable[[], tuple[DataFrame, DataFrame]],
                 conn_type: str = "device") -> Callable[[DataFrame, int], None]:
    """The work per micro-batch: store readings, state, replies, commands and updates.

    ``dimensions`` returns devices and connections and is called per batch, so that new and deleted
    devices are seen. Every write replaces its own batch folder, so a replay repeats nothing; device and
    dashboard jobs may share a store, for each writes below its own kind of connection.
    """
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        devices, connections = dimensions()
        outcomes = decisions(batch, devices, conn_type).persist(StorageLevel.MEMORY_AND_DISK)
        targets = steps = None
        try:
            first, last = presence.time_span(outcomes)  # fills the cache, so the source is read once
            if first is None:
                return
            # Steps are made for the devices of the batch only. These are counted first, so that their real size decides
            # how connections meet them.
            targets = ingest.new_values(outcomes).select("device_id").distinct().persist(StorageLevel.MEMORY_AND_DISK)
            targets.count()
            concerned = connections.join(targets, "device_id", "left_semi")
            steps = presence.presence_steps(concerned, first, last).persist(StorageLevel.MEMORY_AND_DISK)
            placed = presence.with_senders(outcomes, steps, connections)
            readings = ingest.new_readings(outcomes)
            owned = routing.with_owner(ingest.new_updates(placed), devices)
            answers = ingest.replies(placed)
            write_all(batch_id, {
                store.readings: readings.withColumn("day", F.to_date("ts")),
                store.strays: ingest.stray_values(outcomes),
                store.latest: state.current_values(ingest.new_values(outcomes)),
                store.points: series.last_points(readings, store.kept_points),
                store.replies: ingest.reply_frames(answers),
                store.commands: routing.command_frames(ingest.new_commands(outcomes)),
                store.outbox: routing.outbox(owned)}, conn_type)
        finally:
            for kept in (outcomes, targets, steps):
                if kept is not None:
                    kept.unpersist()
    return each_batch


def history_job(messages: DataFrame, devices: DataFrame, path: str, checkpoint: str, conn_type: str = "device",
                trigger: str | None = TRIGGER, retention: str | None = None) -> StreamingQuery:
    """Append the readings of messages to a history below ``path``, by day, with Spark's own file sink.

    The sink's log names the files of finished batches, so that readers (:func:`read_history`) need no listing of
    folders, and a replayed batch adds nothing twice. ``retention``, e.g. ``90d``, lets files older than that drop out
    of the log; :func:`sweep_history` then removes them. ``devices`` is the registry as of the start of the job.
    """
    rows = ingest.new_readings(decisions(messages, devices, conn_type)).withColumn("day", F.to_date("ts"))
    writer = (rows.writeStream.format("parquet").outputMode("append").partitionBy("day")
              .option("path", path).option("checkpointLocation", checkpoint))
    if retention:
        writer = writer.option("retention", retention)
    return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(READING + ", day date").parquet(path)


def sweep_history(spark: SparkSession, path: str, min_age_seconds: int = 86_400) -> int:
    """Remove files that no reader sees: left by failed attempts, or past the retention. Returns their number.

    Files younger than ``min_age_seconds`` stay, for their batch may not have ended, or a reader may have begun earlier.
    Lists the day folders once, in the driver; meant to run now and then, not with every batch.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    named = {f.rsplit("/", 1)[1] for f in read_history(spark, path).inputFiles()}
    limit, removed = jvm.System.currentTimeMillis() - 1000 * min_age_seconds, 0
    for status in files.globStatus(jvm.org.apache.hadoop.fs.Path(root, "day=*/*.parquet")) or []:
        if status.getPath().getName() not in named and status.getModificationTime() <= limit:
            removed += files.delete(status.getPath(), False)
    for status in files.globStatus(jvm.org.apache.hadoop.fs.Path(root, "day=*")) or []:
        if not files.listStatus(status.getPath()) and status.getModificationTime() <= limit:
            files.delete(status.getPath(), False)
    return removed


def current_value_job(readings: DataFrame, table: BatchTable, checkpoint: str,
                      trigger: str | None = TRIGGER) -> StreamingQuery:
    """Live current values as streaming state: each batch writes the sensors that changed."""
    return run(state.current_values(readings), lambda rows, batch_id: table.write(batch_id, rows),
               checkpoint, trigger, mode="update")


def connection_job(events: DataFrame, table: BatchTable, checkpoint: str,
                   trigger: str | None = TRIGGER) -> StreamingQuery:
    """Latest steps per connection; the state follows from ``connection_state(reduced rows)``."""
    return run(events, lambda rows, batch_id: table.write(batch_id, conns.connection_steps(rows)),
               checkpoint, trigger)


def delete_batch(devices: Callable[[], DataFrame], connections: Callable[[], DataFrame], deleted: BatchTable,
                 closes: BatchTable, revoked: BatchTable | None = None) -> Callable[[DataFrame, int], None]:
    """The work per micro-batch of :func:`delete_job`; the batch is read once and feeds all outputs."""
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            as_of = history.latest_time(batch)
            if as_of is None:
                return
            earlier = deleted.read(before=batch_id)  # not this batch's own folder, which a replay overwrites
            left = conns.without(devices(), earlier.select("device_id"), "device_id")
            gone = conns.deleted_ids(conns.delete_results(batch, left, "device_id"), "device_id")
            # The written ids decide the other outputs too, so that these cannot disagree.
            deleted.write(batch_id, gone.withColumn("at_batch", F.lit(batch_id).cast("long")))
            gone = deleted.batch(batch_id).select("device_id")
            outputs = {closes: conns.close_events(connections(), gone, as_of)}
            if revoked is not None:
                outputs[revoked] = conns.revoked_keys(tables.registry(devices()), gone).select("device_id", "secret_key")
            write_all(batch_id, outputs)
        finally:
            batch.unpersist()
    return each_batch


def delete_job(requests: DataFrame, devices: Callable[[], DataFrame], connections: Callable[[], DataFrame],
               deleted: BatchTable, closes: BatchTable, checkpoint: str,
               trigger: str | None = TRIGGER, revoked: BatchTable | None = None) -> StreamingQuery:
    """Delete requests: record the deleted devices, close their open connections and take back their keys.

    ``requests`` holds request_id, ts, device_id and user_id.
    """
    return run(requests, delete_batch(devices, connections, deleted, closes, revoked), checkpoint, trigger)


REVOKED = "device_id long, secret_key string"
DELETED = "device_id long, at_batch long"
CLOSES = "conn_key long, event string, ts timestamp_ntz, device_id long"


def handshake_job(rows: DataFrame, registry: Callable[[], DataFrame], table: BatchTable, checkpoint: str,
                  trigger: str | None = TRIGGER) -> StreamingQuery:
    """First accepted and refused auth request per waiting connection.

    ``rows`` holds conn_key, opened_at (set on the opening row), ts and raw (set on message rows).
    Verdicts at any moment are ``handshake_verdicts(reduce_handshake_steps(table.read()), moment)``.
    """
    def each_batch(batch: DataFrame, batch_id: int) -> None:
        opens = batch.where(F.col("opened_at").isNotNull()).select("conn_key", "opened_at")
        attempts = conns.auth_attempts(batch.where(F.col("raw").isNotNull()).select("conn_key", "ts", "raw"), registry())
        table.write(batch_id, conns.handshake_steps(opens, attempts))
    return run(rows, each_batch, checkpoint, trigger)
