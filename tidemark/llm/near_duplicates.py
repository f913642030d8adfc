"""Near-duplicate documents: multi-index Hamming join over b-bit min-hash signatures, links confirmed on full sets.

A document's set holds its runs of ``k`` words. Equal sets form a class; classes, not copies, are compared. A signature
has ``chunks * WIDTH`` min-hashes of 16 bits each. By pigeonhole two signatures that differ in at most
``2 * chunks - 1`` places agree in some chunk but for one error; so every chunk is filed once for each place that may be
wrong, under the other places, and all such pairs share a bucket. The number of chunks follows from the similarity asked
for, so that a pair at that similarity misses every bucket with a probability of at most ``MISS`` (8 chunks at 0.85, 11
at 0.8); every pair that shares a bucket and fits by size can be confirmed, however far its signatures are apart.

Buckets may be of any size. In each, all members are first confirmed against the member with the smallest id, then,
where a bucket still spans several components, against the one with the largest; what is still apart is compared in full,
in pairs of blocks of about ``BLOCK`` members, nearest signatures first. So no link between components is lost, and a group of
thousands of near copies does not write out its pairs. Blocks pass on links, not pairs.

Documents without words have an empty set, are linked with nothing and kept. Null ids are linked with nothing. Rows that
share an id count as one document's texts, each judged; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import bound_batches, map_slices, mixed, seeds, shingle_hashes, table, utf8
from tidemark.llm.graphs import components
from tidemark.session import stored

WIDTH = 5              # places of a chunk, one of which may be wrong
MISS = 1e-6            # probability that a pair at the similarity asked for shares no bucket
BLOCK = 256
BROADCAST_IDS = 1_000_000


def blank_words(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return utf8(text).lower().split()


def chunks_for(percent: int) -> int:
    """Chunks of a signature, so that a pair of that similarity shares no bucket with a probability of at most ``MISS``."""
    alike = percent / 100
    met = alike ** WIDTH + WIDTH * alike ** (WIDTH - 1) * (1 - alike)
    return max(1, ceil(log(MISS) / log(1 - met))) if met < 1 else 1


def set_of(text: str | None, words: Callable[[str | None], list[bytes]], k: int) -> np.ndarray:
    return np.unique(shingle_hashes(words(text), k))


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> bytes:
    """The low 16 bits of each min-hash; long sets in slices, so that memory stays bounded."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 4096):
        x = hashes[i:i + 4096, None] * multipliers[None, :]
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * multipliers[None, :]).min(axis=0))
    return mixed(least).astype(np.uint16).tobytes()


def sketches(docs: DataFrame, words=blank_words, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set) and signature of every row."""
    multipliers = seeds(chunks_for(percent) * WIDTH, 4)

    def run(batch: dict) -> dict:
        out = {"doc_id": batch["doc_id"], "n_shingles": [], "set_hash": [], "signature": []}
        for text in batch["text"]:
            hashes = set_of(text, words, k)
            out["n_shingles"].append(len(hashes))
            out["set_hash"].append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
            out["signature"].append(signature(hashes, multipliers) if len(hashes) else None)
        return out

    return map_slices(docs.select(F.col("doc_id").cast("long"), "text"), run,
                    "doc_id long, n_shingles long, set_hash binary, signature binary")


def bucket_entries(classes: DataFrame, percent: int = 85) -> DataFrame:
    """(bucket, id): each chunk of each signature, once for every place that may be wrong."""
    chunks = chunks_for(percent)
    places = chunks * WIDTH
    slots = mixed(np.arange(1, places + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, chunks, WIDTH)
            keys = np.empty((len(ids), places), np.uint64)
            for chunk in range(chunks):
                for wrong in range(WIDTH):
                    packed = np.zeros(len(ids), np.uint64)
                    for place in range(WIDTH):
                        if place != wrong:
                            packed = (packed << np.uint64(16)) | signs[:, chunk, place].astype(np.uint64)
                    keys[:, chunk * WIDTH + wrong] = mixed(packed ^ slots[chunk * WIDTH + wrong])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, places))],
                                             names=["bucket", "id"])

    return classes.select("id", "signature").mapInArrow(run, "bucket long, id long")


def shared_buckets(classes: DataFrame, percent: int = 85) -> DataFrame:
    """Entries of buckets with at least two members; single ones are found by counting and go first."""
    entries = bucket_entries(classes, percent)
    several = (entries.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high"))
    return entries.join(several.select("bucket"), "bucket", "left_semi")


def sets_for(docs: DataFrame, ids: DataFrame, words, k: int) -> DataFrame:
    """(id, elements): the full sets of the given documents, as sorted hashes. ``ids`` is broadcast only if counted small."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    return map_slices(rows, lambda b: {"id": b["id"], "elements": [set_of(t, words, k).tobytes() for t in b["text"]]},
                    "id long, elements binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("id").alias(c), F.col("elements").alias(f"set_{c}")) for c in "ab")

    def run(batch: dict) -> dict:
        out: dict = {"a": [], "b": []}
        for a, b, x, y in zip(batch["a"], batch["b"], batch["set_a"], batch["set_b"]):
            if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent):
                out["a"].append(a)
                out["b"].append(b)
        return out

    return map_slices(pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b"), run, "a long, b long")


def split_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that still span several components, with their component."""
    known = (members.join(labels, "id", "left")
             .withColumn("component", F.coalesce("component", "id")))
    apart = (known.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
             .where("low < high").select("bucket"))
    return known.join(apart, "bucket", "left_semi")


def leader_pairs(members: DataFrame, leader) -> DataFrame:
    """Each member with the leader of its bucket, where they are of different components."""
    first = members.groupBy("bucket").agg(leader(F.struct("id", "component")).alias("leader"))
    return (members.join(first, "bucket").where(F.col("component") != F.col("leader.component"))
            .select(F.least("id", "leader.id").alias("a"), F.greatest("id", "leader.id").alias("b")).distinct())


def block_links(members: DataFrame, classes: DataFrame, docs: DataFrame, words, k: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join components, among members that share buckets, compared block by block.

    Members that are connected by buckets form a family; a pair of blocks of a family is one group, which confirms all
    pairs of a bucket that fit by size on full sets, nearest signatures first, and passes over pairs that its own links
    have already joined.
    """
    chunks = chunks_for(percent)
    first = members.groupBy("bucket").agg(F.min("id").alias("a"))
    family = components(members.join(first, "bucket").select("a", F.col("id").alias("b"))).withColumnRenamed("component", "family")
    rows = members.select("id", "component").distinct().join(family, "id")
    sizes = rows.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sets = stored(sets_for(docs, rows.select("id"), words, k).dropDuplicates(["id"]), "family-sets")
    rows = rows.join(sizes, "family").join(classes.select("id", "n_shingles", "signature"), "id").join(sets, "id")
    # Block i meets every block j: the rows of a block go to each such meeting.
    meets = (rows.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")))

    def compare(group: pa.Table) -> pa.Table:
        ids, size, block = (group[c].to_numpy() for c in ("id", "n_shingles", "_own"))
        names, root = np.unique(group["component"].to_numpy(), return_inverse=True)
        signs = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint16).reshape(-1, chunks, WIDTH)
        sets = [np.frombuffer(x, np.uint64) for x in group["elements"].to_pylist()]
        within = group["_i"][0].as_py() == group["_j"][0].as_py()
        a, b = [], []
        for i in range(len(ids) - 1):
            fits = ((root[i + 1:] != root[i]) & (within | (block[i + 1:] != block[i]))
                    & (100 * np.minimum(size[i + 1:], size[i]) >= percent * np.maximum(size[i + 1:], size[i])))
            others = np.flatnonzero(fits) + i + 1
            wrong = (signs[others] != signs[i]).sum(axis=2)
            apart, meet = wrong.sum(axis=1), wrong.min(axis=1) <= 1
            others = others[meet][np.argsort(apart[meet], kind="stable")]
            for j in others.tolist():
                if root[i] != root[j] and linked(sets[i], sets[j], percent):
                    root[root == root[j]] = root[i]
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return (meets.select("family", "_i", "_j", "_own", "id", "component", "n_shingles", "signature", "elements")
            .groupBy("family", "_i", "_j").applyInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, percent: int = 85, words=blank_words, k: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    sketched = stored(sketches(docs, words, k, percent), "sketches")
    classes = stored(sketched.where("set_hash IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_hash").agg(
        F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"), F.max("signature").alias("signature")), "classes")
    # A document with several texts leads with the largest set; its other classes are judged by their own copies.
    one = classes.groupBy("id").agg(F.max(F.struct("n_shingles", "signature")).alias("s")).select("id", "s.*")
    members = stored(shared_buckets(one, percent), "bucket-members")
    labels = members.select("id", F.col("id").alias("component")).limit(0)
    links = None
    tried = None
    for leader in (F.min, F.max):
        pairs = leader_pairs(stored(split_members(members, labels), "apart"), leader)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        good = stored(confirmed(pairs, sets_for(docs, ends, words, k), percent), "links")
        tried, links = (pairs, good) if tried is None else (tried.union(pairs), links.union(good))
        if not good.isEmpty():
            labels = components(links)
    apart = stored(split_members(members, labels), "apart")
    if not apart.isEmpty():
        good = stored(block_links(apart, one, docs, words, k, percent), "links")
        if not good.isEmpty():
            labels = components(links.union(good))
    of_class = classes.select("set_hash", "id").join(labels, "id", "left").select(
        "set_hash", F.coalesce("component", "id").alias("_component"))
    out = sketched.join(of_class, "set_hash", "left")
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      (F.coalesce(component == F.col("doc_id"), F.lit(True))).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 80, words=blank_words, k: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, that of the smallest id.

    A row that repeats a kept id goes too, if rows share ids at all.
    """
    judged = stored(near_duplicates(docs, percent, words, k), "near-duplicates")
    gone = judged.where("NOT kept").select("doc_id").distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    twice = judged.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    return (kept.join(twice, "doc_id", "left_anti")
            .unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])))


def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    bound_batches(spark)
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
