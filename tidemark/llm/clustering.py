"""Centroid clustering of integer vectors with a table of pivot distances (LAESA).

Each component x becomes floor(scale * x). The distances of every vector to a few fixed pivots are computed once and
stored beside it. In every round the difference between a vector's and a centroid's distance to a pivot is a lower bound of
their distance: a vector tries the centroid of smallest bound first, and only centroids whose bound does not exceed the
distance found so far get an exact distance, in integers. The bounds are computed in floating point and widened by more
than their rounding, so no centroid that could win or tie is left out.

Rounds read the stored table and write nothing: a task adds up its vectors per centroid, and these sums, one row a task
and centroid, are added by Spark. Only the centroids reach the driver. Sums are kept in 30-bit parts, so they are exact
for components of any size.

Only vectors of exactly ``dims`` components, none null or non-finite, take part. Repeated rows and ids each count. The
centroids start as the vectors with the smallest sha256 of ``1:<id>`` (ties of one id: smallest vector; rows without
an id come last), fewer if there are fewer vectors. Distances and sums beyond a long become null, the assignment stays
exact. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import FloatType, LongType, StructField, StructType

from tidemark.llm.common import table
from tidemark.session import stored

CENTROIDS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
PIVOTS = 8
SLICE = 4096      # vectors of a batch held as numbers at a time
LIMB = 30
SLACK = 1e-9      # widening of bounds, far above the rounding of square roots
LARGEST = 2 ** 63 - 1


def kept_vectors(frame: DataFrame, id_column: str, vector: str, dims: int) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col(vector) if frame.schema[vector].dataType.elementType == FloatType() else F.col(vector).cast("array<double>")
    return (frame.select(F.col(id_column).alias("vec_id"), v.alias("v"))
            .where((F.size("v") == dims)
                   & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))


def narrow(values: np.ndarray) -> bool:
    """Whether the squared distance of two such rows of whole numbers surely fits in 64 bits."""
    dims = values.shape[-1] if values.ndim else 1
    return not values.size or 4 * dims * float(max(abs(values.min()), abs(values.max()))) ** 2 < 2.0 ** 62


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), x as double: 64-bit integers where distances fit, else Python's."""
    values = values.astype(float)
    if not values.size or np.abs(values).max() < 2.0 ** 60 / scale:
        floors = np.floor(values * scale)
        if narrow(floors):
            return floors.astype(np.int64)
    return np.array([int(x) * scale if abs(x) >= 2.0 ** 53 else math.floor(x * scale) for x in values.ravel().tolist()],
                    dtype=object).reshape(values.shape)


def packed(rows: list[list[int]]) -> np.ndarray:
    """Rows of integers as an array, of 64-bit ones where distances fit."""
    wide = np.array(rows, dtype=object)
    return wide.astype(np.int64) if max((abs(x) for r in rows for x in r), default=0) < 2 ** 53 and narrow(wide) else wide


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    gap = left - right
    return (gap * gap).sum(axis=-1)


def roots_of(distances: np.ndarray) -> np.ndarray:
    """Square roots as doubles, infinite where too large for one."""
    if distances.dtype != object:
        return np.sqrt(distances.astype(float))
    root = lambda d: math.sqrt(d) if d < 2 ** 1000 else float(math.isqrt(d)) if d < 2 ** 2000 else math.inf
    return np.array([root(d) for d in distances.ravel().tolist()], dtype=float).reshape(distances.shape)


class Nearest:
    """Nearest centroids by pivot bounds."""

    def __init__(self, centroids: list[list[int]], pivots: list[list[int]]):
        self.centroids = packed(centroids)
        known = packed(pivots)
        self.to_pivots = roots_of(np.stack([squared(self.centroids, p) for p in known], axis=1))

    def assign(self, vectors: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the nearest centroid, squared distance and count of exact distances taken, for each vector.

        Ties go to the smaller number.
        """
        n, k = len(vectors), len(self.centroids)
        bound = np.zeros((n, k))
        for p in range(to_pivots.shape[1]):
            own, theirs = to_pivots[:, p, None], self.to_pivots[None, :, p]
            with np.errstate(invalid="ignore"):
                gap = np.abs(own - theirs) - SLACK * (own + theirs)
            np.maximum(bound, np.where(np.isfinite(gap), gap, 0.0), out=bound)
        best = bound.argmin(axis=1)
        distance = squared(vectors, self.centroids[best])
        first, reach, tested = best.copy(), roots_of(distance), np.ones(n, np.int32)
        for j in range(k):
            rows = np.flatnonzero((bound[:, j] <= reach * (1 + SLACK)) & (first != j))
            if not len(rows):
                continue
            found = squared(vectors[rows], self.centroids[j])
            tested[rows] += 1
            nearer = (found < distance[rows]) | ((found == distance[rows]) & (j < best[rows]))
            rows, found = rows[nearer], found[nearer]
            best[rows], distance[rows], reach[rows] = j, found, roots_of(found)
        return best, distance, tested


def slices(batch: pa.RecordBatch, scale: int, size: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch with the vectors of each."""
    for start in range(0, batch.num_rows, size):
        part = batch.slice(start, size)
        flat = part.column(part.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
        yield part, whole(flat.reshape(part.num_rows, -1), scale)


def pivot_table(vectors: DataFrame, pivots: list[list[int]], scale: int) -> DataFrame:
    """Adds the distance of each vector to each pivot, written once."""
    schema = StructType([*vectors.schema.fields, *StructType.fromDDL("to_pivots array<double>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = packed(pivots)
        for batch in batches:
            for part, rows in slices(batch, scale):
                near = roots_of(np.stack([squared(rows, p) for p in known], axis=1))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(near.tolist(), pa.list_(pa.float64()))],
                    names=[*part.schema.names, "to_pivots"])

    return stored(vectors.mapInArrow(run, schema), "pivots")


def distances_of(part: pa.RecordBatch) -> np.ndarray:
    column = part.column(part.schema.get_field_index("to_pivots"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def limbs(number: int) -> list[int]:
    """Parts of 30 bits, the lowest first; the last one has the sign."""
    parts = []
    while not -(1 << LIMB) < number < (1 << LIMB):
        parts.append(number & ((1 << LIMB) - 1))
        number >>= LIMB
    return [*parts, number]


def moved(rows: DataFrame, centroids: list[list[int]], pivots: list[list[int]], scale: int) -> list[list[int]]:
    """Centroids after one round: the floored means of their vectors; an empty one stays."""
    dims = len(centroids[0])
    names = [f"s{i}" for i in range(dims)]
    schema = StructType([StructField(n, LongType()) for n in ("cluster", "limb", "n", *names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Nearest(centroids, pivots)
        counts, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
        for batch in batches:
            for part, vectors in slices(batch, scale):
                best, _, _ = search.assign(vectors, distances_of(part))
                for j in np.unique(best).tolist():
                    own = vectors[best == j]
                    counts[j] += len(own)
                    sums[j] = [a + b for a, b in zip(sums[j], own.sum(axis=0).tolist())]
        out = []
        for j, n in enumerate(counts):
            if n:
                parts = [limbs(s) for s in sums[j]]
                for limb in range(max(map(len, parts))):
                    out.append((j, limb, n if limb == 0 else 0, *(p[limb] if limb < len(p) else 0 for p in parts)))
        columns = list(zip(*out)) or [()] * len(schema)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=schema.names)

    added = rows.select("v", "to_pivots").mapInArrow(run, schema).groupBy("cluster", "limb").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)]).collect()
    counts, sums = {}, {}
    for r in added:  # a row per centroid and part
        counts[r["cluster"]] = counts.get(r["cluster"], 0) + int(r["n"])
        own = sums.setdefault(r["cluster"], [0] * dims)
        for i, name in enumerate(names):
            own[i] += int(r[name]) << (LIMB * r["limb"])
    return [[s // counts[j] for s in sums[j]] if j in counts else c for j, c in enumerate(centroids)]


def assigned(rows: DataFrame, centroids: list[list[int]], pivots: list[list[int]], scale: int) -> DataFrame:
    """The rows with cluster, distance (null beyond a long) and n_exact, the number of exact distances taken."""
    kept = StructType([f for f in rows.schema.fields if f.name not in ("v", "to_pivots")])
    schema = StructType([*kept.fields, *StructType.fromDDL("cluster int, distance long, n_exact int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Nearest(centroids, pivots)
        for batch in batches:
            for part, vectors in slices(batch, scale):
                best, distance, tested = search.assign(vectors, distances_of(part))
                columns = [part.column(part.schema.get_field_index(n)) for n in kept.names]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(best.tolist(), pa.int32()),
                     pa.array([d if d <= LARGEST else None for d in distance.tolist()], pa.int64()),
                     pa.array(tested)], names=schema.names)

    return rows.mapInArrow(run, schema)


def starting(vectors: DataFrame, k: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest hash of their id."""
    first = (vectors.withColumn("_hash", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
             .orderBy(F.col("_hash").asc_nulls_last(), "v").limit(k).collect())
    return [whole(np.array([r["v"]]), scale)[0].tolist() for r in first]


def clustered(frame: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS,
              rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE,
              n_pivots: int = PIVOTS) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, n_exact) of every kept vector, stored, and the final centroids.

    Pivots are the first ``n_pivots`` starting vectors; they stay while the centroids move.
    """
    vectors = kept_vectors(frame, id_column, vector, dims)
    centroids = starting(vectors, k, scale)
    if not centroids:
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"),
                              F.lit(0).alias("n_exact")), []
    pivots = centroids[:n_pivots]
    rows = pivot_table(vectors, pivots, scale)
    for _ in range(rounds):
        centroids = moved(rows, centroids, pivots, scale)
    return stored(assigned(rows, centroids, pivots, scale), "clusters"), centroids


def with_inertia(rows: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """Adds the distance sums of the own cluster and of all (null beyond a long), and the hash of the centroid."""
    whole_sum = F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")))
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(whole_sum.alias("s")).collect()}  # k rows at most

    def number(value: int | None):
        return F.lit(value if value is not None and value <= LARGEST else None).cast("long")

    total = sum(map(int, sums.values())) if None not in sums.values() else None
    own, digest = F.lit(None).cast("long"), F.lit(None).cast("string")
    for j, centroid in enumerate(centroids):
        here = F.col("cluster") == j
        own = F.when(here, number(int(sums[j]) if sums.get(j) is not None else None)).otherwise(own)
        digest = F.when(here, hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()).otherwise(digest)
    return rows.select("*", own.alias("cluster_inertia"), number(total).alias("inertia"), digest.alias("centroid_sha256"))


def op12_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return with_inertia(*clustered(table(spark, folder, "embeddings"))).drop("n_exact")
