"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Inner products become distances by one more coordinate (the root of the largest squared norm less the own one). Vectors
are projected on ``dims`` Gaussian directions; the index is dealt into parts of about ``part_rows`` vectors by a hash, and
each part builds a kd-tree over its projections. A query visits the leaves of a part by growing projected distance. A
squared projected distance over the squared true one follows a chi-square law, so a vector nearer than the k-th found
projects, with probability ``sure``, within a radius that follows from the k-th true distance. Inside a leaf only projected
neighbours within that radius are verified by their inner products, and the visit stops at the first leaf beyond it; the
radius only shrinks, so all that the test asks for are verified. Every vector is indexed and every query sees every part;
queries are dealt into blocks, so no task holds all of either.

Vectors that are null, zero, hold null or non-finite components or have another length than most take no part, nor do
rows without an id. Repeated rows are each candidates; a repeated query id is answered once. Empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import table

DIMS = 16
SURE = 0.95
PART_ROWS = 16_384
BLOCK_ROWS = 4_096
LEAF = 192
STEP = 16
SEED = 11


def chi_square(x: np.ndarray | float, dims: int) -> np.ndarray | float:
    """Distribution function of the chi-square law for an even number of degrees."""
    half = np.asarray(x, dtype=float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def radius(sure: float, dims: int) -> float:
    """The squared radius that holds a chi-square variable with probability ``sure``."""
    low, high = 0.0, 1.0
    while chi_square(high, dims) < sure:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dims) < sure else (low, middle)
    return high


class KdTree:
    """Leaves of a kd-tree over projected points: ``order`` lists the points leaf by leaf, ``ends`` where each leaf ends."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        leaves: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            if len(rows) <= leaf:
                leaves.append(np.sort(rows))
                continue
            own = points[rows]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = np.argpartition(own[:, axis], len(rows) // 2)
            stack += [rows[half[:len(rows) // 2]], rows[half[len(rows) // 2:]]]
        self.order = np.concatenate(leaves)
        self.ends = np.cumsum([len(r) for r in leaves])
        self.low = np.array([points[r].min(axis=0) for r in leaves])
        self.high = np.array([points[r].max(axis=0) for r in leaves])

    def by_distance(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by their least squared distance from the query, and these distances."""
        gap = np.maximum(0.0, np.maximum(self.low - query, query - self.high))
        distance = (gap * gap).sum(axis=1)
        order = np.argsort(distance, kind="stable")
        return order, distance[order]


class Part:
    """One part of the index: ids, vectors and projected points in the order of the tree's leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        self.tree = KdTree(points)
        at = self.tree.order
        self.ids, self.vectors, self.points = ids[at], np.ascontiguousarray(vectors[at]), np.ascontiguousarray(points[at])
        self.norms = (self.points * self.points).sum(axis=1)
        self.rows = np.split(np.arange(len(at)), self.tree.ends[:-1])  # by leaf
        self.verified = 0  # inner products taken, for reports

    def nearest(self, query: np.ndarray, own: int, projected: np.ndarray, largest: float, k: int,
                within: float) -> tuple[np.ndarray, np.ndarray]:
        """The k found: (ids, inner products), largest first, ties by id."""
        leaves, gaps = self.tree.by_distance(projected)
        found_ids, found = np.empty(0, np.int64), np.empty(0)
        base = float(query @ query) + largest
        slack, shift = 1e-12 * base, float(projected @ projected)
        reach = least = None  # squared projected radius and k-th product, once k are found
        at, step = 0, 1
        while at < len(leaves) and (reach is None or gaps[at] <= reach):
            # A few leaves at a time, ever more, for the radius changes less and less.
            rows = np.concatenate([self.rows[leaf] for leaf in leaves[at:at + step].tolist()])
            at, step = at + step, min(2 * step, STEP)
            if reach is not None:
                away = self.norms[rows] + shift - 2 * (self.points[rows] @ projected)
                rows = rows[away <= reach]
            self.verified += len(rows)
            if least is not None:  # a quick product first; what may count is added up in one order, so equal vectors tie
                rows = rows[self.vectors[rows] @ query >= least - slack]
            rows = rows[self.ids[rows] != own]
            if not len(rows):
                continue
            scores = (self.vectors[rows] * query).sum(axis=1)
            found_ids, found = np.concatenate([found_ids, self.ids[rows]]), np.concatenate([found, scores])
            best = np.lexsort((found_ids, -found))[:k]
            found_ids, found = found_ids[best], found[best]
            if len(found) == k:
                least = float(found[-1])
                reach = within * max(base - 2 * least, slack) * (1 + 1e-9) + slack
        return found_ids, found


def usable(frame: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col("vector")
    rows = (frame.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
            .where(F.col("id").isNotNull() & v.isNotNull())
            .where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                   & F.exists(v, lambda x: x != 0)))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (size["n"] if size else 0))


def nearest_neighbours(frame: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding",
                       dims: int = DIMS, sure: float = SURE, part_rows: int = PART_ROWS,
                       block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest found. ``is_query`` is over the column ``id``."""
    rows = usable(frame, id_column, vector)
    facts = rows.agg(F.count("*").alias("n"), F.sum(is_query.cast("int")).alias("queries"), F.max(F.size("vector")).alias("size"),
                     F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("largest")).first()
    parts = max(1, math.ceil(facts["n"] / part_rows))
    blocks = max(1, math.ceil((facts["queries"] or 0) / block_rows))
    size, largest = facts["size"] or 1, (facts["largest"] or 1.0) * (1 + 1e-12)
    directions = np.random.default_rng(SEED).normal(size=(size + 1, dims))
    within = radius(sure, dims)

    def pick(numbers: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(numbers)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = rows.select("id", "vector", F.lit(False).alias("asks"), pick(parts, 1).alias("part"), every(blocks).alias("block"))
    queries = (rows.where(is_query).dropDuplicates(["id"])
               .select("id", "vector", F.lit(True).alias("asks"), every(parts).alias("part"), pick(blocks, 2).alias("block")))

    def search(group: pa.Table) -> pa.Table:
        ids, asks = group["id"].to_numpy(), group["asks"].to_numpy(zero_copy_only=False)
        vectors = group["vector"].combine_chunks().flatten().to_numpy().reshape(-1, size)
        at, known, vectors_in = ids[asks], ids[~asks], vectors[~asks]
        out: dict = {"query_id": [], "vec_id": [], "score": []}
        if len(at) and len(known):
            order = np.argsort(known, kind="stable")
            known, vectors_in = known[order], vectors_in[order]
            extra = np.sqrt(np.maximum(0.0, largest - (vectors_in * vectors_in).sum(axis=1)))
            part = Part(known, vectors_in, np.column_stack([vectors_in, extra]) @ directions)
            asked = vectors[asks]
            projected = np.column_stack([asked, np.zeros(len(asked))]) @ directions
            for own, query, place in zip(at.tolist(), asked, projected):
                found, scores = part.nearest(query, own, place, largest, k, within)
                out["query_id"] += [own] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += scores.tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64())})

    found = index.unionByName(queries).groupBy("part", "block").applyInArrow(
        search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"), F.col("id") % 20 == 0)
