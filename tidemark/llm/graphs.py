"""Connected components over links, by hooking and pointer jumping on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.session import stored

JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (a, b); the component is the smallest id.

    Each round hooks every vertex to its smallest smaller neighbour, follows the hooks twice doubling, and replaces the
    ends of all links; links within one vertex go. Rounds grow with the logarithm of the longest path. Each round is
    written to the shared folder, so lineage stays short and lost executors cost one round at most.
    """
    u, v = F.least("a", "b"), F.greatest("a", "b")
    edges = stored(links.select(u.alias("u"), v.alias("v")).where("u < v").distinct(), "edges")
    labels = (edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("component", F.col("id")))
    while not edges.isEmpty():
        first = stored(edges.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("to")), "hooks")
        hooks = first
        for _ in range(JUMPS):
            hooks = moved(hooks, "to", hooks)
        labels = stored(moved(labels, "component", hooks), "labels")
        ends = moved(moved(edges, "u", hooks), "v", hooks)
        edges = stored(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                       .where("u < v").distinct(), "edges")
    return labels


def moved(rows: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """``column`` replaced by where its hook leads."""
    hook = hooks.select(F.col("id").alias("_from"), F.col("to").alias("_to"))
    return (rows.join(hook, rows[column] == hook["_from"], "left")
            .withColumn(column, F.coalesce("_to", column)).select(rows.columns))
