"""Which connections of a device are open at the time of each message.

The openings and closings of a device make steps: from one moment to the next the number of open connections is
constant. Steps are cut into time slices, so that the steps of a busy device, and its messages, are spread over tasks, and a
message meets only the steps of its own slice. Counts inside a slice build on the count at its start, which follows
from one row per device and slice.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.payload import compute_once
from tidemark.operators.history import time_literal
from tidemark.session import stored

SLICE_HOURS = 168


def slice_of(ts: Column, hours: int) -> Column:
    """Number of the time slice a moment falls in."""
    since = F.datediff(ts.cast("date"), F.to_date(F.lit("1970-01-01"))).cast("long") * 24 + F.hour(ts)
    return F.floor(since / hours).cast("long")


def slice_number(moment: datetime, hours: int) -> int:
    """The same for a moment known in the driver."""
    return ((moment.date() - datetime(1970, 1, 1).date()).days * 24 + moment.hour) // hours


def live_spans(connections: DataFrame) -> DataFrame:
    """From when to when each device connection is authenticated and open; ``until`` is null while it lasts."""
    return (connections.where((F.col("conn_type") == "device") & F.col("auth_at").isNotNull()
                              & F.col("opened_at").isNotNull() & F.col("device_id").isNotNull())
            .select("conn_key", "device_id", F.greatest("opened_at", "auth_at").alias("since"),
                    F.col("closed_at").alias("until"))
            .where(F.col("until").isNull() | (F.col("until") > F.col("since"))))


def presence_steps(connections: DataFrame, first: datetime, last: datetime, hours: int = SLICE_HOURS) -> DataFrame:
    """Steps of every device for moments from ``first`` to ``last``.

    Rows: device_id, slice, since (null: from the start of the slice), until (null: to its end), n_open, and ``newest``,
    the connection that started last so far. Times without an open connection have no row. What happened before the first
    slice is reduced to one count per device.
    """
    low, high = slice_number(first, hours), slice_number(last, hours)
    spans = live_spans(connections)
    one = F.lit(1).cast("long")
    nobody = F.lit(None).cast(f"struct<since:{spans.schema['since'].dataType.simpleString()},conn_key:bigint,"
                              f"until:{spans.schema['until'].dataType.simpleString()}>")
    changes = spans.select("device_id", F.inline(F.array(
        F.struct(F.col("since").alias("at"), one.alias("delta"), F.struct("since", "conn_key", "until").alias("newest")),
        F.struct(F.col("until").alias("at"), (-one).alias("delta"), nobody.alias("newest")))))
    moments = (changes.where(F.col("at") <= time_literal(changes, last, "at")).groupBy("device_id", "at")
               .agg(F.sum("delta").alias("delta"), F.max("newest").alias("newest")))
    # Read twice below; the generator keeps the filter on slices above the aggregate, so that one shuffle serves both.
    moments = compute_once(moments, {"slice": F.greatest(slice_of(F.col("at"), hours), F.lit(low - 1))})
    # One row per device and slice with changes: what holds at its end, up to the next such slice.
    so_far = Window.partitionBy("device_id").orderBy("slice")
    ends = moments.groupBy("device_id", "slice").agg(F.sum("delta").alias("delta"), F.max("newest").alias("newest")).select(
        "device_id", F.sum("delta").over(so_far).alias("delta"), F.max("newest").over(so_far).alias("newest"),
        (F.col("slice") + 1).alias("_from"),
        F.least(F.coalesce(F.lead("slice").over(so_far), F.lit(high)), F.lit(high)).alias("_to"))
    starts = ends.where(F.col("_from") <= F.col("_to")).select(
        "device_id", F.lit(None).cast(changes.schema["at"].dataType).alias("at"), "delta", "newest",
        F.explode(F.sequence("_from", "_to")).alias("slice"))
    inside = Window.partitionBy("device_id", "slice").orderBy(F.col("at").asc_nulls_first())
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (moments.where(F.col("slice") >= low).unionByName(starts)
            .select("device_id", "slice", F.col("at").alias("since"), F.lead("at").over(inside).alias("until"),
                    F.sum("delta").over(running).alias("n_open"), F.max("newest").over(running).alias("newest"))
            .where(F.col("n_open") > 0))


def stored_steps(connections: DataFrame, first: datetime | None, last: datetime | None,
                 hours: int = SLICE_HOURS) -> DataFrame:
    """The steps written once, so that their real size decides how messages meet them."""
    if first is None:
        first = last = datetime(1970, 1, 1)
    return stored(presence_steps(connections, first, last, hours), "presence")


def time_span(rows: DataFrame) -> tuple[datetime | None, datetime | None]:
    """First and last time of the rows."""
    return tuple(rows.agg(F.min("ts"), F.max("ts")).first())


def at_each(rows: DataFrame, steps: DataFrame, device: str, spread: str, hours: int = SLICE_HOURS) -> DataFrame:
    """Add ``n_open``, the open connections of ``device`` at ``ts``, and ``newest_key``, the one that started last if open.

    Steps of a device do not overlap, so each row meets one at most. Rows are the preserved side, which adaptive
    execution may split; rows without a device are spread by ``spread``.
    """
    left = rows.withColumns({"_slice": slice_of(F.col("ts"), hours),
                             "_spread": F.when(F.col(device).isNull(), F.xxhash64(spread)).otherwise(0)})
    right = steps.select(F.col("device_id").alias("_device"), F.col("slice").alias("_at_slice"), F.col("since").alias("_since"),
                         F.col("until").alias("_until"), F.col("n_open").alias("_n_open"), F.col("newest").alias("_newest"),
                         F.lit(0).cast("long").alias("_zero"))
    ts = F.col("ts")
    met = left.join(right, (F.col(device) == F.col("_device")) & (F.col("_slice") == F.col("_at_slice"))
                    & (F.col("_spread") == F.col("_zero")) & (F.col("_since").isNull() | (F.col("_since") <= ts))
                    & (F.col("_until").isNull() | (ts < F.col("_until"))), "left")
    lasting = F.col("_newest.until").isNull() | (F.col("_newest.until") > ts)
    return met.select(*rows.columns, F.coalesce("_n_open", F.lit(0).cast("long")).alias("n_open"),
                      F.when(lasting, F.col("_newest.conn_key")).alias("newest_key"))


def with_senders(outcomes: DataFrame, steps: DataFrame, connections: DataFrame | None = None,
                 hours: int = SLICE_HOURS) -> DataFrame:
    """Add ``sender_key``, the connection a device message came over, and ``n_sent``, the other open connections of its target.

    ``outcomes`` holds msg_id, ts, conn_type, outcome and target_id. With a ``sender_key`` column that is the connection, and
    ``connections`` tells whether it is an open one of the target; without it a device's newest open connection stands in.
    """
    concerned = F.col("outcome").isin("command", "data")
    given = "sender_key" in outcomes.columns
    keyed = outcomes.withColumn("_target", F.when(concerned, F.col("target_id")))
    known = at_each(keyed, steps, "_target", "msg_id", hours)
    if given:
        spans = live_spans(connections).select(F.col("conn_key").alias("_sender"), F.col("device_id").alias("_owner"),
                                               F.col("since").alias("_from"), F.col("until").alias("_to"),
                                               F.lit(0).cast("long").alias("_zero"))
        known = known.withColumn("_spread", F.when(F.col("sender_key").isNull(), F.xxhash64("msg_id")).otherwise(0))
        known = known.join(spans, (F.col("sender_key") == F.col("_sender")) & (F.col("_spread") == F.col("_zero")), "left")
        own = ((F.col("_owner") == F.col("_target")) & (F.col("_from") <= F.col("ts"))
               & (F.col("_to").isNull() | (F.col("_to") > F.col("ts"))))
        sender = F.col("sender_key")
    else:
        sender = F.when(F.col("conn_type") == "device", F.col("newest_key"))
        own = sender.isNotNull()
    n_sent = F.col("n_open") - F.when(F.coalesce(own, F.lit(False)), 1).otherwise(0)
    kept = [c for c in outcomes.columns if c != "sender_key"]
    return known.select(*kept, sender.alias("sender_key"), n_sent.alias("n_sent"))
