"""Nearest neighbours against brute force."""

import numpy as np

from tidemark.llm import neighbours
from tidemark.llm.neighbours import F


def test_recall_and_order(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(3000, 24))
    vectors[100:140] = vectors[20]  # ties
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    odd = [(4000, None), (4020, [0.0] * 24), (4040, [float("nan")] * 24), (4060, [1.0]), (4080, [None] * 24), (None, [1.0] * 24)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {}
    for r in neighbours.nearest_neighbours(frame, F.col("id") % 20 == 0, part_rows=700, block_rows=60).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for query, found in got.items():
        scores = (vectors * vectors[query]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(3000), -scores)).tolist() if i != query][:20]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and len({v for _, v, _ in found}) == 20
        assert all(abs(s - scores[v]) < 1e-12 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        hits += len(set(order) & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    assert neighbours.nearest_neighbours(frame.limit(0), F.col("id") % 20 == 0).count() == 0


def test_chi_square_law():
    rng = np.random.default_rng(3)
    sample = (rng.normal(size=(20000, 8)) ** 2).sum(axis=1)
    for x in (3.0, 8.0, 15.0):
        assert abs(neighbours.chi_square(x, 8) - (sample < x).mean()) < 0.02


def test_radius_and_what_it_leaves_out():
    """Few directions and clusters: the test leaves points out, and every point within the last radius was looked at."""
    for dims in (8, 16):
        assert abs(neighbours.chi_square(neighbours.radius(0.95, dims), dims) - 0.95) < 1e-9
    rng = np.random.default_rng(5)
    vectors = np.repeat(rng.normal(size=(40, 24)) * 4, 100, axis=0) + rng.normal(size=(4000, 24)) * 0.3
    ids, largest = np.arange(4000), float((vectors * vectors).sum(axis=1).max())
    directions = rng.normal(size=(25, 8))
    extra = np.sqrt(np.maximum(0, largest - (vectors * vectors).sum(axis=1)))
    points = np.column_stack([vectors, extra]) @ directions
    part = neighbours.Part(ids, vectors, points)
    assert sorted(part.ids.tolist()) == ids.tolist()
    within, hits, missed = neighbours.radius(0.95, 8), 0, 0
    for q in range(0, 4000, 50):
        place = np.append(vectors[q], 0) @ directions
        found, scores = part.nearest(vectors[q], q, place, largest, 20, within)
        assert q not in found and len(found) == 20
        products = (vectors * vectors[q]).sum(axis=1)
        true = [i for i in np.lexsort((ids, -products)).tolist() if i != q][:20]
        hits += len(set(true) & set(found.tolist()))
        last = within * (vectors[q] @ vectors[q] + largest - 2 * scores[-1])
        near = np.flatnonzero(((points - place) ** 2).sum(axis=1) <= last)
        missed += len(set(near[products[near] > scores[-1]].tolist()) - set(found.tolist()) - {q})
    assert hits >= 0.9 * 20 * 80 and missed == 0
    assert part.verified < 0.6 * 80 * 4000
