"""Mixing against plain loops over the slots, and its invariants."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing
from tidemark.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def wanted_targets(sizes, weights=(1, 2, 3), most=3):
    """Sources by name, null last; shares by weight, capped, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while total:
        free = [s for s in order if s not in fixed]
        share = Fraction(total - sum(fixed.values()), sum(weight[s] for s in free))
        above = [s for s in free if share * weight[s] > most * sizes[s]]
        if not above:
            return {**fixed, **{s: share * weight[s] for s in free}}
        fixed.update({s: most * sizes[s] for s in above})
    return dict.fromkeys(order, 0)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = lambda n: " ".join(rng.choice(["a", "bb", "é", "x y", "z\x0bz"]) + str(rng.randrange(9)) for _ in range(n))
    out = [(i, words(rng.randint(0, 60)), rng.choice(["hot", "hot", "b", "c", None])) for i in range(120)]
    return out + [(3, words(9), "b"), (3, words(9), "b"), (None, words(5), "c"), (200, None, "hot"), (201, "", "only empty"),
                  (202, " \t\r\n ", "b"), (203, words(3000), "hot"), (204, "one\ttwo\n three", "tiny"), (205, "q", "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows],
                                 "doc_id long, text string, source string, size int, shard int")


@pytest.mark.parametrize("block_words, shard_slots", [(7, 16), (1, 5), (4096, 8)])
def test_mix_equals_its_slots_read_one_by_one(spark, docs, rows, block_words, shard_slots):
    made = mixing.mix(docs, with_text=True, block_words=block_words, shard_slots=shard_slots)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    want = wanted_targets(sizes)
    sources = {r["source_no"]: r for r in made.sources.collect()}
    name = lambda r: None if r["no_source"] else r["source_key"]
    assert {name(r): r["source_size"] for r in sources.values()} == dict(sizes)
    assert all(abs(r["target"] - want[name(r)]) < 1e-6 for r in sources.values())

    texts = mixing.mixed_texts(made).collect()
    slots = made.slots.collect()
    assert len(texts) == len(slots) == sum(r["n_slots"] for r in sources.values())
    assert all(len(r["text"].split(" ")) == r["n_words"] <= block_words for r in texts)
    per_shard, per_source, used = {}, Counter(), Counter()
    for r in texts:
        per_shard.setdefault(r["shard"], []).append(r["position"])
        per_source[r["source_no"]] += r["n_words"]
        used[r["source_no"], r["block"]] += 1
    assert all(sorted(p) == list(range(len(p))) and len(p) <= shard_slots for p in per_shard.values())
    assert {n: per_source[n] for n in sources} == {n: round(r["target"]) for n, r in sources.items()}
    for n, r in sources.items():  # every block once before any twice
        counts = [used[n, b] for b in range(r["n_blocks"])]
        assert not counts or max(counts) - min(counts) <= 1 and max(counts) <= 3

    found = mixing.taken(made)
    known = {r["row_id"]: r for r in made.docs.collect()}
    counted = Counter()  # words of every document, read off the slots
    for s in slots:
        for r in known.values():
            if r["source_no"] == s["source_no"]:
                low, high = s["block"] * block_words, s["block"] * block_words + s["n_words"]
                counted[r["row_id"]] += max(0, min(high, r["start"] + r["size"]) - max(low, r["start"]))
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in found.collect()) == Counter(
        (r["doc_id"], r["size"], counted[i]) for i, r in known.items())
    assert found.count() == len(rows) and found.where("taken > 3 * size or taken is null").isEmpty()
    again = mixing.taken(mixing.mix(docs.repartition(7), block_words=block_words, shard_slots=shard_slots))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, found.collect()), key=repr)


def test_draws_follow_the_targets(spark):
    docs = spark.createDataFrame([(i, "w " * 400, "abc"[i % 3]) for i in range(60)], "doc_id long, text string, source string")
    made = mixing.mix(docs, block_words=4, shard_slots=100)
    counts = {(r["shard"], r["source_no"]): r["count"] for r in made.slots.groupBy("shard", "source_no").count().collect()}
    shards = {s for s, _ in counts if s < 60}
    assert len(shards) == 60
    for number, p in ((1, 1 / 6), (2, 1 / 3), (3, 1 / 2)):
        drawn = np.array([counts.get((s, number), 0) for s in shards])
        assert abs(drawn.mean() - 100 * p) < 3 and 0.4 < drawn.var() / (100 * p * (1 - p)) < 1.9


def test_permutation():
    for n in (1, 2, 3, 5, 64, 65, 1000):
        index, key = np.arange(n), np.full(n, 77, np.uint64)
        there = mixing.permuted(index, np.full(n, n), key)
        assert sorted(there) == list(range(n))
        assert (mixing.permuted(there, np.full(n, n), key, back=True) == index).all()
    assert (mixing.permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, 78, np.uint64)) != there).mean() > 0.9


def test_no_words(spark, docs):
    assert mixing.taken(mixing.mix(docs.limit(0))).count() == 0
    only = mixing.taken(mixing.mix(docs.where("size(split(text, ' ')) = 1 and trim(text) = ''"))).collect()
    assert only and all(r["target"] == 0 and r["taken"] == 0 for r in only)


def test_query(spark):
    rows = mixing.op13_mixing(spark, FOLDER)
    sources = {r["doc_id"]: r["source"] for r in table(spark, FOLDER, "documents").collect()}
    got = rows.collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[sources[r["doc_id"]]] += r["size"]
        taken[sources[r["doc_id"]]] += r["taken"]
    want = wanted_targets(sizes)
    assert len(got) == len(sources) and all(r["taken"] <= 3 * r["size"] for r in got)
    assert all(abs(r["target"] - want[sources[r["doc_id"]]]) < 1e-6 for r in got)
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    assert rows.where(F.col("source_size").isNull()).isEmpty()
