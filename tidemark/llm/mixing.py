"""Mixes sources to target weights: fixed-length blocks, multinomial draws per shard, index permutations.

The words of a source, document after document, are packed into blocks of ``block_words`` words; the last one may be
shorter. A source's target is its share by weight of all words, at most ``most`` times its own; what is above goes to the
others by weight until none is above. An output shard has ``shard_slots`` slots, each of one block. Every slot draws a
source with a probability in proportion to its target, so the counts of a shard are a multinomial draw. The
slots of a source are numbered through all shards, and slot i takes the block that a pseudorandom permutation of the
source's block numbers gives for i, with another permutation after each whole pass. Draws beyond what a source's target
needs are left out, and slots still lacking fill further shards; the last slot of a source takes only the words
that are left. So a source gives exactly its rounded target, and no block is taken more than ``most`` times. Slots and
documents meet by joining (source, block).

Nothing is held per source in one task: positions are prefix sums over range partitions, and slots find their source by
an interval join on equal buckets. All choices are hashes of positions and ``seed``, so reruns agree; documents are
packed in order of id, size and a hash of the text.

A null or empty text has size 0 and gives nothing; a null source is a source of its own, the last; rows of a repeated or
null id each count; a long text spans many blocks; no documents or no words give targets of 0; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import map_slices, mixed, table, utf8
from tidemark.operators.joins import lookup
from tidemark.operators.numbering import number_rows
from tidemark.session import stored

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK_WORDS = 256
SHARD_SLOTS = 1024
SEED = 13
FEISTEL_ROUNDS = 4
ROW_BITS = 33  # rows of one partition

SOURCE = ["no_source", "source_key"]  # null as a flag, so that sources can be joined
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True


def n_words(text: str | None) -> int:
    """Number of maximal runs without a blank of ASCII."""
    data = np.frombuffer(utf8(text), np.uint8)
    if not len(data):
        return 0
    word = ~BLANK[data]
    return int(word[0]) + int(np.count_nonzero(word[1:] & ~word[:-1]))


def running_sums(rows: DataFrame, order: list[str], within: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one of its group, and ``row_id``, a number of the row.

    ``order`` starts with ``within``, columns without nulls. Rows are range partitioned and summed as they pass; one
    row per partition and group gives the offsets. The rows are stored in between, so a retry cannot renumber them.
    """
    schema = StructType([*rows.schema.fields, StructField(name, LongType()), StructField("row_id", LongType())])
    keys, at = [rows.columns.index(c) for c in within], rows.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_id, group, total = TaskContext.get().partitionId() << ROW_BITS, None, 0
        for batch in batches:
            groups = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
            sums = []
            for here, n in zip(groups, batch.column(at).to_pylist()):
                if here != group:
                    group, total = here, 0
                sums.append(total)
                total += n
            ids = np.arange(row_id, row_id + len(sums))
            row_id += len(sums)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64()), pa.array(ids, pa.int64())],
                                             names=schema.names)

    local = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "running")
    part = F.shiftright("row_id", ROW_BITS).alias("_part")
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (local.groupBy(part, *within).agg(F.sum(value).alias("_n"))
               .select("_part", *within, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (local.withColumn("_part", part).join(offsets, ["_part", *within])
            .withColumn(name, F.col(name) + F.col("_before")).select(schema.names))


def sized(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, source, the source's key, size, a hash of the text, and the text if asked for."""
    text = ["text"] if with_text else []
    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in ("doc_id", "source", *text))

    def run(b: dict) -> dict:
        return {**{n: b[n] for n in ("doc_id", "source", *text)}, "size": [n_words(t) for t in b["text"]],
                "text_hash": b["text_hash"]}

    rows = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash"))
    return map_slices(rows, run, f"{kinds}, size long, text_hash long").select(
        "*", F.col("source").isNull().alias("no_source"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source_key"))


def packed(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Documents with ``start``, the words of their source before them."""
    rows = sized(docs, with_text)
    return running_sums(rows, [*SOURCE, "doc_id", "size", "text_hash"], SOURCE, "size", "start")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Each source with its number, source_size, weight and target. ``rows`` holds the sizes of documents.

    Sources above the limit are set to it and the rest is shared again, until none is above: the share of a weight of 1 only
    grows, and each turn is one aggregate over the sources.
    """
    sizes = rows.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    turn = ((F.col("source_no") - 1) % len(weights)).cast("int")
    known = stored(number_rows(sizes, SOURCE, name="source_no").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)), "sources")
    total = known.agg(F.sum("source_size")).first()[0] or 0
    share, limit = Fraction(0), F.col("source_size") * most
    wide = "decimal(38,0)"
    while total:
        above = (F.col("weight").cast(wide) * F.lit(share.numerator).cast(wide)
                 > limit.cast(wide) * F.lit(share.denominator).cast(wide))
        free, full = known.agg(F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, limit))).first()
        higher = Fraction(total - (full or 0), free)
        if higher == share:
            break
        share = higher
    return known.withColumn("target", F.least(F.col("weight") * F.lit(float(share)), limit.cast("double")))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Where a keyed permutation of 0 to n - 1 takes each index (``back``: its inverse).

    A Feistel network over the next even number of bits, repeated while the result is not below n.
    """
    u = np.uint64
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 1) // 2).astype(u)
    mask = (u(1) << half) - u(1)
    out, open_ = index.astype(u), np.arange(len(index))
    n = n.astype(u)
    while len(open_):
        h, m, k = half[open_], mask[open_], key[open_]
        left, right = out[open_] >> h, out[open_] & m
        for r in range(FEISTEL_ROUNDS):
            salt = u((FEISTEL_ROUNDS - r if back else r + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
            if back:
                left, right = right ^ (mixed(left ^ mixed(k ^ salt)) & m), left
            else:
                left, right = right, left ^ (mixed(right ^ mixed(k ^ salt)) & m)
        out[open_] = (left << h) | right
        open_ = open_[out[open_] >= n[open_]]
    return out.astype(np.int64)


def keys_of(source_no: np.ndarray, turn: np.ndarray, seed: int) -> np.ndarray:
    return mixed(mixed(source_no.astype(np.uint64) + np.uint64(seed << 32)) + turn.astype(np.uint64))


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Adds quota (rounded target), n_blocks, n_slots and cut, the words of the last slot (0: all of its block).

    Slots before the last one of a pass under way take whole blocks, of which the source's last may be short; where the
    permutation puts it decides how many slots the rest needs.
    """
    columns = ("source_no", "source_size", "quota")
    whole = sources.withColumn("quota", F.round("target").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, size, quota = (batch.column(i).to_numpy() for i in range(3))
            blocks = -(-size // block_words)
            turns, rest = quota // np.maximum(size, 1), quota % np.maximum(size, 1)
            short = block_words - (size - (blocks - 1) * block_words)  # words the last block lacks
            at = permuted(np.maximum(blocks - 1, 0), np.maximum(blocks, 1), keys_of(number, turns, seed), back=True)
            slots = -(-rest // block_words)
            passed = slots > at
            slots = np.where(passed, -(-(rest + short) // block_words), slots)
            cut = rest - ((slots - 1) * block_words - np.where(slots - 1 > at, short, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (number, blocks, turns * blocks + slots, np.where(rest > 0, cut, 0))],
                names=["source_no", "n_blocks", "n_slots", "cut"])

    facts = whole.select(*columns).mapInArrow(run, "source_no long, n_blocks long, n_slots long, cut long")
    return stored(whole.join(facts, "source_no"), "quotas")


def drawn(sources: DataFrame, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """(source_no, shard, n): how often each of the shard's slots drew each source."""
    starts = running_sums(sources.select("source_no", "quota").where("quota > 0").withColumn("all", F.lit(0)),
                          ["all", "source_no"], ["all"], "quota", "low")
    words, count = starts.agg(F.sum("quota"), F.count("*")).first()
    width = max(1, -(-words // count))
    high = F.col("low") + F.col("quota")
    places = stored(starts.select("source_no", "low", high.alias("high"), F.explode(F.sequence(
        F.expr(f"low div {width}"), F.expr(f"(low + quota - 1) div {width}"))).alias("bucket")), "places")
    draws = sources.sparkSession.range(n_slots).select(
        F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(words)).alias("at"))
    return (draws.withColumn("bucket", F.expr(f"at div {width}")).join(places, "bucket")
            .where((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
            .groupBy("source_no", "shard").agg(F.count("*").alias("n")))


def slots_of(sources: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS,
             seed: int = SEED) -> DataFrame:
    """(shard, source_no, index, block, n_words): every slot of the mix, the block it takes and how many words of it."""
    empty = sources.sparkSession.createDataFrame([], "shard long, source_no long, index long, block long, n_words long")
    total = sources.agg(F.sum("n_slots")).first()[0] or 0
    if not total:
        return empty
    counts = running_sums(drawn(sources, total, shard_slots, seed), ["source_no", "shard"], ["source_no"], "n", "first")
    needs = sources.select("source_no", "source_size", "n_blocks", "n_slots", "cut")
    end = F.least(F.col("first") + F.col("n"), "n_slots")
    met = counts.join(needs, "source_no").where(F.col("first") < F.col("n_slots")).select(
        "shard", *needs.columns, F.explode(F.sequence("first", end - 1)).alias("index"))
    seen = counts.groupBy("source_no").agg(F.sum("n").alias("seen"))
    lacking = (needs.join(seen, "source_no", "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
               .withColumn("lacks", F.col("n_slots") - F.col("seen")).where("lacks > 0").withColumn("all", F.lit(0)))
    further = running_sums(lacking, ["all", "source_no"], ["all"], "lacks", "before").select(
        "before", "seen", *needs.columns, F.explode(F.sequence("seen", F.col("n_slots") - 1)).alias("index"))
    shards = -(-total // shard_slots)
    rest = further.select(F.expr(f"{shards} + (before + index - seen) div {shard_slots}").alias("shard"),
                          *needs.columns, "index")
    names = ["shard", "source_no", "index", "block", "n_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, number, size, blocks, slots, cut, index = (c.to_numpy() for c in batch.columns)
            block = permuted(index % blocks, blocks, keys_of(number, index // blocks, seed))
            taken = np.minimum(block_words, size - block * block_words)
            taken = np.where((index == slots - 1) & (cut > 0), cut, taken)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (shard, number, index, block, taken)],
                                             names=names)

    return met.unionByName(rest).select("shard", *needs.columns, "index").mapInArrow(
        run, ", ".join(f"{n} long" for n in names))


@dataclass
class Mix:
    """Packed documents, sources with their targets, and the slots of the mix."""

    docs: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int


def mix(docs: DataFrame, with_text: bool = False, weights: tuple[int, ...] = WEIGHTS, most: int = MOST,
        block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Mix:
    rows = packed(docs, with_text)
    sources = quotas(targets(rows, weights, most), block_words, seed)
    numbered = lookup(rows, sources.select(*SOURCE, "source_no"), SOURCE, "row_id")
    return Mix(numbered, sources, stored(slots_of(sources, block_words, shard_slots, seed), "slots"), block_words)


def pieces(made: Mix) -> DataFrame:
    """The documents cut at block borders: block, and the piece's first and end word within it; null where empty."""
    b = made.block_words
    blocks = F.when(F.col("size") > 0, F.sequence(F.expr(f"start div {b}"), F.expr(f"(start + size - 1) div {b}")))
    left = F.greatest(F.col("start") - F.col("block") * b, F.lit(0))
    right = F.least(F.col("start") + F.col("size") - F.col("block") * b, F.lit(b))
    return made.docs.withColumn("block", F.explode_outer(blocks)).withColumns({"piece_first": left, "piece_end": right})


def taken(made: Mix) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of every document."""
    b = made.block_words
    whole = F.col("n_words") >= F.least(F.lit(b), F.col("source_size") - F.col("block") * b)
    uses = (made.slots.join(made.sources.select("source_no", "source_size"), "source_no").groupBy("source_no", "block")
            .agg(F.sum(F.when(whole, 1).otherwise(0)).alias("uses"), F.sum(F.when(~whole, F.col("n_words"))).alias("cut")))
    words = (F.coalesce("uses", F.lit(0)) * (F.col("piece_end") - F.col("piece_first"))
             + F.greatest(F.least("piece_end", F.coalesce("cut", F.lit(0))) - F.col("piece_first"), F.lit(0)))
    met = lookup(pieces(made).drop("source", *SOURCE, "text_hash"), uses, ["source_no", "block"], "row_id")
    per_doc = met.groupBy("row_id", "doc_id", "size", "source_no").agg(F.sum(words).alias("taken"))
    known = made.sources.select("source_no", F.when(~F.col("no_source"), F.col("source_key")).alias("source"),
                                "source_size", "target")
    return lookup(per_doc, known, "source_no", "row_id").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(made: Mix) -> DataFrame:
    """(shard, position, source_no, block, n_words, text): the blocks of every shard in pseudorandom order.

    ``made`` comes from :func:`mix` with text. A slot's text is at most ``block_words`` words, joined by a space.
    """
    b = made.block_words

    def cut(rows: dict) -> dict:
        out: dict = {"source_no": [], "block": [], "piece_first": [], "words": []}
        for number, start, text in zip(rows["source_no"], rows["start"], rows["text"]):
            words = utf8(text).split()
            at = 0
            while at < len(words):
                block, first = divmod(start + at, b)
                piece = words[at:at + b - first]
                at += len(piece)
                for name, value in zip(out, (number, block, first, b" ".join(piece).decode("utf-8", "surrogatepass"))):
                    out[name].append(value)
        return out

    parts = map_slices(made.docs.select("source_no", "start", "text"), cut,
                       "source_no long, block long, piece_first long, words string")
    shown = F.slice(F.split("words", " "), F.lit(1), F.greatest(F.col("n_words") - F.col("piece_first"), F.lit(0)).cast("int"))
    met = (made.slots.join(parts, ["source_no", "block"]).where(F.col("piece_first") < F.col("n_words"))
           .groupBy("shard", "source_no", "index", "block", "n_words")
           .agg(F.sort_array(F.collect_list(F.struct("piece_first", F.array_join(shown, " ").alias("words")))).alias("_parts")))
    mingled = Window.partitionBy("shard").orderBy(F.xxhash64("source_no", "index"), "source_no", "index")
    return met.select("shard", (F.row_number().over(mingled) - 1).alias("position"), "source_no", "block", "n_words",
                      F.array_join("_parts.words", " ").alias("text"))


def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return taken(mix(table(spark, folder, "documents"))).drop("source")
