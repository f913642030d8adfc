"""Lookups that stay balanced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def lookup(rows: DataFrame, table: DataFrame, keys: str | list[str], spread: str) -> DataFrame:
    """Left join of ``rows`` to ``table``, which has unique keys.

    Rows with a null key match nothing, but would all be shuffled to one task; they are spread over the
    tasks by the ``spread`` column. Rows of a hot key are on the preserved side, which adaptive execution may split.
    """
    keys = [keys] if isinstance(keys, str) else keys
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    left = rows.withColumn("_spread", F.when(unknown, F.xxhash64(spread)).otherwise(0))
    return left.join(table.withColumn("_spread", F.lit(0).cast("long")), [*keys, "_spread"], "left").drop("_spread")
