"""Consecutive numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.session import stored

_PART_BITS = 33  # monotonically_increasing_id keeps the row index of a partition in the low 33 bits


def number_rows(rows: DataFrame, order: list[str], start: int = 0, name: str = "row_no") -> DataFrame:
    """Add consecutive numbers ``start + 1, ...`` in the given order, which must be unique.

    Rows are range partitioned and numbered inside each partition (:func:`positions`).
    """
    return positions(rows.repartitionByRange(*order).sortWithinPartitions(*order), start, name)


def positions(rows: DataFrame, start: int = 0, name: str = "row_no") -> DataFrame:
    """Add the place of each row in the order in which ``rows`` come, ``start + 1, ...``

    Rows are numbered inside each partition; the partitions' counts give the offsets. The numbered rows are stored
    between the two steps, so a retry cannot renumber them. The offset window sees one row per partition.
    """
    tagged = stored(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    tagged = tagged.withColumn("_part", F.shiftright("_at", _PART_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (tagged.groupBy("_part").agg(F.count("*").alias("_n"))
               .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = F.col("_at").bitwiseAND(F.lit((1 << _PART_BITS) - 1).cast("long"))
    # One row per range partition, however many rows there are: bounded by the number of shuffle partitions.
    return (tagged.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.lit(start + 1).cast("long") + F.col("_before") + inside)
            .drop("_at", "_part", "_before"))
