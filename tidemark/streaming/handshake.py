"""Handshake verdicts as they fall due, by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

LIMIT_MS = 20_000  # Fixed value: time a connection may wait unauthenticated.

BLOCKS = 4096  # of connections whose state is kept together
REDUCE_ROWS = 1_000_000  # rows of a block held before they are reduced

VERDICT = "conn_key long, verdict string, decided_ms long"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def handshake_processor() -> StatefulProcessor:
    """A new state processor.

    Its class is made here so that Spark sends it by value: the worker that sets a stream up in the driver does not look
    among the files added to a session, so it may be unable to import this module.
    """
    limit_ms, none, reduce_rows = LIMIT_MS, np.iinfo(np.int64).max, REDUCE_ROWS
    table = np.dtype([("id", np.int64), ("limit", np.int64), ("first_ms", np.int64), ("good", bool)])

    def earliest(ids: np.ndarray, ms: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, ...]:
        """One row per connection and kind of event."""
        order = np.lexsort((ms, event, ids))
        ids, ms, event = ids[order], ms[order], event[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (event[1:] != event[:-1])
        return ids[new], ms[new], event[new]

    def due(waiting: np.ndarray) -> np.ndarray:
        """The limit; without a known opening, that of a connection opened at the request."""
        return np.where(waiting["limit"] == none, waiting["first_ms"] + limit_ms, waiting["limit"])

    class HandshakeProcessor(StatefulProcessor):
        """Holds the waiting connections of a block until an auth request or the timer decides.

        Input rows: id, ms and event, 0 for an opening, 1 for a refused request, 2 for an accepted one, null for the clock,
        which only moves the watermark and leaves no state. State is, for each waiting connection, the time limit and the
        earliest decisive request so far, since rows of one connection arrive in any order; and the one timer of the block,
        set for the connection that is due next. Every question to the state is a round trip to Spark, so a block asks
        once for all its connections.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getValueState("waiting", "timer_ms long, connections binary")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            parts, size, least = [], 0, 0
            for frame in rows:
                if frame["ms"].hasnans:
                    raise ValueError("an event has no time")
                frame = frame[frame["event"].notna()]
                parts.append((frame["id"].to_numpy(np.int64), frame["ms"].to_numpy(np.int64), frame["event"].to_numpy(np.int8)))
                size += len(frame)
                if size > least + reduce_rows:  # many rows of few connections need little memory
                    parts = [earliest(*map(np.concatenate, zip(*parts)))]
                    size = least = len(parts[0][0])
            if not size:
                return
            ids, ms, event = earliest(*map(np.concatenate, zip(*parts)))
            timer, known = self.stored()
            waiting = np.empty(len(every := np.union1d(known["id"], ids)), table)
            waiting["id"], waiting["limit"], waiting["first_ms"], waiting["good"] = every, none, none, False
            waiting[np.searchsorted(every, known["id"])] = known
            place = np.searchsorted(every, ids)
            opened = event == 0
            waiting["limit"][place[opened]] = ms[opened] + limit_ms
            for kind in (1, 2):
                # At equal times the accepted request wins, so it is looked at last.
                at, when = place[event == kind], ms[event == kind]
                before = (when <= waiting["first_ms"][at]) if kind == 2 else (when < waiting["first_ms"][at])
                waiting["first_ms"][at[before]] = when[before]
                waiting["good"][at[before]] = kind == 2
            self.keep(timer, waiting)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            _, waiting = self.stored()
            ends = due(waiting)
            over = ends <= timerValues.getCurrentWatermarkInMs()  # as Spark's timers
            self.keep(None, waiting[~over])
            # A request without an opening has waited long enough.
            closed = waiting[over & (waiting["limit"] != none)]
            if len(closed):
                decided = closed["first_ms"] < closed["limit"]
                verdict = np.where(decided, np.where(closed["good"], "accepted", "bad_key"), "timeout")
                ids = pd.array(closed["id"], "Int64") if key[0] is not None else pd.array([None] * len(closed), "Int64")
                yield pd.DataFrame({"conn_key": ids, "verdict": verdict.astype(object),
                                    "decided_ms": np.where(decided, closed["first_ms"], closed["limit"])})

        def stored(self) -> tuple[int | None, np.ndarray]:
            found = self.waiting.get()
            return (None, np.empty(0, table)) if found is None else (found[0], np.frombuffer(found[1], table))

        def keep(self, timer: int | None, waiting: np.ndarray) -> None:
            """Store the connections that wait, with a timer for the next one due."""
            if not len(waiting):
                self.waiting.clear()
                return
            next_ms = int(due(waiting).min())
            if timer is None or next_ms < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(next_ms)
                timer = next_ms
            self.waiting.update((timer, waiting.tobytes()))

        def close(self) -> None:
            pass

    return HandshakeProcessor()


def block_of(conn_key: Column) -> Column:
    """The block of a connection, by hash; negative keys and null, which no real connection has, are blocks of their own."""
    return F.when(conn_key.isNull() | (conn_key < 0), conn_key).otherwise(F.pmod(F.xxhash64(conn_key), F.lit(BLOCKS)))


def handshake_verdict_stream(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """One verdict per connection, emitted when the watermark passes its time limit.

    ``events`` holds conn_key, ts (timestamp) and event. Only rows that can decide, and ``clock`` rows, which move the
    watermark where nothing else does, get here; other traffic of a waiting connection costs nothing. State is kept by block of
    connections (:func:`block_of`). Needs the RocksDB state store (:func:`write_verdicts`).
    """
    event = F.col("event")
    decisive = events.where(event.isin("open", "good", "bad", "clock")).select("conn_key", "ts", "event")
    timed = decisive.withWatermark("ts", delay).select(
        block_of(F.col("conn_key")).alias("conn_key"), F.coalesce("conn_key", F.lit(0)).cast("long").alias("id"),
        F.unix_millis("ts").alias("ms"),
        F.when(event == "open", 0).when(event == "bad", 1).when(event == "good", 2).cast("tinyint").alias("event"), "ts")
    return (timed.groupBy("conn_key")
            .transformWithStateInPandas(handshake_processor(), outputStructType=VERDICT, outputMode="append", timeMode="EventTime")
            .select("conn_key", "verdict", F.timestamp_millis("decided_ms").alias("decided_at")))


def write_verdicts(verdicts: DataFrame, path: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Start the stream into parquet files, with the only state store that has timers, whatever the session names."""
    conf = verdicts.sparkSession.conf
    was = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ROCKSDB)
    try:
        writer = verdicts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
    finally:
        conf.unset(STATE_STORE) if was is None else conf.set(STATE_STORE, was)


def decisive_events(opens: DataFrame, attempts: DataFrame) -> DataFrame:
    """Events of :func:`handshake_verdict_stream` from opened connections and their auth attempts."""
    return (opens.select("conn_key", F.col("opened_at").cast("timestamp").alias("ts"), F.lit("open").alias("event"))
            .unionByName(attempts.where("is_auth").select(
                "conn_key", F.col("ts").cast("timestamp").alias("ts"),
                F.when(F.col("key_ok"), "good").otherwise("bad").alias("event"))))
