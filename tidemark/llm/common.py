"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Word characters of the contracts: ASCII digits and letters, and everything beyond ASCII. ``WORD_BYTES`` maps
# UTF-8 bytes: A-Z to lower case, other word bytes to themselves, the rest to a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))

# The same for Spark's functions.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SLICE_BYTES = 4 << 20
BATCH_BYTES = "8m"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words of letters and digits in UTF-8, A-Z lower-cased; null has none."""
    return utf8(text).translate(WORD_BYTES).split()


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out from every fit."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def map_rows(frame: DataFrame, function: Callable[[dict], Iterator[dict] | list[dict]], schema: str) -> DataFrame:
    """Run ``function`` over Arrow batches given as column lists; it returns column lists under ``schema``.

    ``function`` takes {column: list} and returns {column: list}. Batches are those of Spark, so memory stays
    bounded by ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows.
    """
    target = arrow_schema(frame.sparkSession, schema)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = function({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    return frame.mapInArrow(batches, schema)


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold at most ``BATCH_BYTES``, whatever the texts' lengths, unless it says otherwise."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if setting not in spark.conf.getAll:
        spark.conf.set(setting, BATCH_BYTES)


def byte_slices(batch: pa.RecordBatch, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``budget`` bytes, or of one row."""
    if batch.nbytes <= budget or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from byte_slices(batch.slice(0, half), budget)
    yield from byte_slices(batch.slice(half), budget)


def map_slices(frame: DataFrame, function: Callable[[dict], dict], schema: str) -> DataFrame:
    """As :func:`map_rows`, but ``function`` sees at most ``SLICE_BYTES`` of rows at a time, however long texts are."""
    target = arrow_schema(frame.sparkSession, schema)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for part in byte_slices(batch):
                out = function({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
        pa.default_memory_pool().release_unused()  # workers are used again

    return frame.mapInArrow(batches, schema)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The value before each element: ``start`` for the first, then ``step`` (associative) over all elements before it.

    An aggregate that appends to its array copies it at every step. Here the elements are taken in blocks of about the
    square root of their number, each with its own running values, so the work grows with the power 1.5, not 2.
    """
    def walked(part: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda a, x: F.concat(a, F.array(step(F.element_at(a, -1), x))))

    def of_blocks(parts: Column) -> Column:
        before = walked(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, b: F.transform(
            F.slice(p, F.lit(1), F.size(p) - 1), lambda x: step(b, x))))

    def blocks(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(a), width), lambda i: walked(F.slice(a, i, width)))

    return F.when(F.size(values) == 0, F.slice(F.array(start), 1, 0)).otherwise(
        bound(values, lambda a: bound(blocks(a), of_blocks)))


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = values ^ (values >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """One 64-bit hash for each run of ``k`` words; fewer words count as one run, none as no run."""
    hashes = word_hashes(words)
    return run_hashes(hashes, min(k, len(words))) if words else hashes


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash for each run of ``k`` of the hashes."""
    n = len(hashes)
    runs = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[j:n - k + 1 + j]
        runs ^= runs >> np.uint64(29)
    return mixed(runs)


def seeds(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 1)) | np.uint64(1)


def min_hashes(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each multiplier."""
    return np.array([mixed_min(hashes, m) for m in multipliers], np.uint64)


def mixed_min(hashes: np.ndarray, multiplier: np.uint64) -> np.uint64:
    x = hashes * multiplier
    x ^= x >> np.uint64(32)
    return (x * multiplier).min()
