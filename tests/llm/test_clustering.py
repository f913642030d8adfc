"""Centroid clustering against plain loops in Python's integers."""

import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import clustering


def brute(rows, k, rounds, dims, scale=64):
    kept = [(i, [math.floor(scale * x) if abs(x) < 2 ** 53 else int(x) * scale for x in v], v) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "~"
    centroids = [v for _, v, _ in sorted(kept, key=lambda r: (digest(r[0]), r[2]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else c
                     for j, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v, _ in kept]
    sums, fit = Counter(), lambda x: x if x < 2 ** 63 else None
    for _, d, j in found:
        sums[j] += d
    return Counter((i, j, fit(d), fit(sums[j]), fit(sum(sums.values())),
                    hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found)


def check(spark, rows, kind="array<float>", k=5, rounds=3, dims=6):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding {kind}").withColumn("distance", F.lit("clash"))
    found, centroids = clustering.clustered(frame, k=k, rounds=rounds, dims=dims, n_pivots=3)
    out = clustering.with_inertia(found, centroids)
    stored = [(r[0], [x for x in r[1]] if r[1] is not None else None) for r in frame.select("vec_id", "embedding").collect()]
    got = Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"])
                  for r in out.collect())
    want = brute(stored, k, rounds, dims)
    if kind == "array<double>":  # a sum is null where one of its distances is
        return got, want
    assert got == want
    return out


def test_equals_loops(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(rng.choice([-1, 0, 2]), 0.3) for _ in range(6)]) for i in range(300)]
    rows += [(i, [rng.choice([-1e-20, 0.0, 1 / 64, -1 / 64]) for _ in range(6)]) for i in range(300, 360)]  # ties, tiny
    rows += rows[:20] + [(7, [9.0] * 6), (None, [1.0] * 6), (400, None), (401, []), (402, [1.0] * 5), (403, [None] + [1.0] * 5),
                         (404, [float("nan")] + [1.0] * 5), (405, [float("-inf")] + [1.0] * 5)]
    out = check(spark, rows)
    assert out.where("vec_id is null").count() == 1 and out.where("n_exact > 5").isEmpty()
    assert out.agg(F.avg("n_exact")).first()[0] < 5
    check(spark, rows[:3])     # fewer vectors than centroids
    check(spark, [(1, [0.5] * 6)] * 40 + [(2, [0.25] * 6)])  # equal starting vectors: the smaller number wins
    assert check(spark, rows[:1], rounds=0).count() == 1


def test_huge_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 3e38 for _ in range(6)]) for i in range(12)] + [(20, [0.5] * 6), (21, [0.75] * 6)]
    check(spark, rows)
    got, want = check(spark, [(i, [rng.uniform(-1, 1) * 1.7e308] * 6) for i in range(9)] + [(30, [1.0] * 6)], "array<double>")
    assert {r[:2] for r in got} == {r[:2] for r in want} and {r[5] for r in got} == {r[5] for r in want}


def test_no_vectors(spark):
    frame = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    rows = clustering.with_inertia(*clustering.clustered(frame))
    assert rows.count() == 0 and "centroid_sha256" in rows.columns
