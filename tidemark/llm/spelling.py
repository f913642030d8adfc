"""Groups spelling variants: words one edit apart, found by scanning sorted vocabulary with reused edit-matrix rows.

Words are counted over all texts, reduced per task before the shuffle. Two words are near if one inserted, deleted or
replaced code point makes them equal. Let m be the length of the shorter word and p the length of the common prefix:
the edit stands at p, and what follows it is common too. So words are filed under what must be equal if p lies in an
interval [a, b): the first a code points and the last m - b. There are two intervals to begin with, the front and the
back half; a key with more than ``group_rows`` words is filed again under both halves of its interval, until the
interval is one position. Then a key holds at most (alphabet + 1) squared words, so no task ever holds a large group,
and every pair is met under exactly one key, with nothing capped.

Inside a key the words are sorted, and each word of length m is compared with all of them by a banded edit matrix (three
cells a row): rows of the prefix shared with the word before are kept, and once a row exceeds one edit the scan
jumps behind all words with that prefix.

A word's form is its near word of largest count if that is at least ``ratio`` times its own (ties: the smallest in
code-point order); the root is reached by following forms, found by pointer doubling (counts grow at every step, so the
chains are short). Null and empty texts hold no words; in rows without an id no run is changed; repeated rows and ids
count as often as they stand; letters beyond Latin-1 separate words; further columns are ignored; an empty table or
vocabulary gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from os.path import commonprefix
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.common import table
from tidemark.session import stored

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
GROUP_ROWS = 512
TASK_ROWS = 20_000
HELD_WORDS = 300_000  # words a counting task holds before it hands them on
NOISE = 199

# Letters in Latin-1: A-Z become lower case, a-z and U+00C0 to U+00FF stay, the rest separates.
LETTER_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Runs of letters as Latin-1 bytes, A-Z lower-cased."""
    return (text or "").encode("latin-1", "replace").translate(LETTER_BYTES).split()


def altered(run: bytes, prefix: int, noise: int) -> bytes:
    """The run without one letter if ``noise`` divides the checksum of ``<id>:<run>``; ``prefix`` is that of ``<id>:``."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    if h % noise:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1:]


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE,
                held: int = HELD_WORDS) -> DataFrame:
    """(word, n) over all documents. ``noise`` 0 leaves all runs as they are."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def flushed(found: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in found]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(found.values()), pa.int64())],
                                          schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, text = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                runs = Counter(runs_of(text))
                prefix = crc32(f"{doc_id}:".encode())
                for run, n in runs.items():
                    word = altered(run, prefix, noise) if noise and doc_id is not None else run
                    if len(word) >= min_length:
                        found[word] += n
                if len(found) >= held:
                    yield flushed(found)
                    found = Counter()
        if found:
            yield flushed(found)

    counted = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def one_edit(words: list[str], m: int) -> Iterator[tuple[int, int]]:
    """Index pairs (i, j) of sorted distinct words of lengths m and m + 1 that are one edit apart.

    Word i has length m; j is longer, or as long and behind i.
    """
    n = len(words)
    lcp = [0] + [len(commonprefix(words[k - 1:k + 1])) for k in range(1, n)]
    for i, query in enumerate(words):
        if len(query) != m:
            continue
        q = query + "\0\0"
        # Row d: distances of the first d letters of the word at hand to the query's first d - 1, d and d + 1.
        rows = [(2, 0, 1)]
        k = 0
        while k < n:
            word = words[k]
            d = min(lcp[k], len(rows) - 1)
            del rows[d + 1:]
            low, mid, high = rows[d]
            size = len(word)
            while d < size:
                c = word[d]
                new_low = min(low + (c != q[d - 1]), mid + 1)
                new_mid = min(mid + (d >= m or c != q[d]), high + 1, new_low + 1)
                high = min(high + (d + 1 >= m or c != q[d + 1]), new_mid + 1)
                low, mid = new_low, new_mid
                d += 1
                if low > 1 and mid > 1 and high > 1:
                    break
                rows.append((low, mid, high))
            else:
                if (mid == 1 and k > i) if size == m else low == 1:
                    yield i, k
                k += 1
                continue
            # No word with this prefix is near: go on behind them.
            k += 1
            if k < n and lcp[k] >= d:
                k = bisect_left(words, word[:d] + "\U0010ffff", k)


KEY = ["m", "a", "b", "key"]


def filed(rows: DataFrame) -> DataFrame:
    """Add the key: what words whose edit lies in [a, b) have in common."""
    tail = F.col("m") - F.col("b")
    front = F.substring("word", F.lit(1), F.col("a"))
    back = F.when(tail > 0, F.substring("word", F.length("word") - tail + 1, tail)).otherwise("")
    return rows.select("word", "n", "m", "a", "b", F.concat(front, F.lit("\t"), back).alias("key"))


def halves(rows: DataFrame, low: str, high: str) -> DataFrame:
    """Each row for both halves of the interval of positions from ``low`` up to ``high``."""
    def part(first: str, end: str) -> Column:
        return F.struct(F.expr(first).cast("int").alias("a"), F.expr(end).cast("int").alias("b"))

    middle = f"({low} + {high}) div 2"
    parts = rows.withColumn("_part", F.explode(F.array(part(low, middle), part(middle, high))))
    return parts.select("word", "n", "m", "_part.a", "_part.b")


def near_words(words: DataFrame, group_rows: int = GROUP_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(word, near, near_n) for every word and each of its near words. ``words`` holds distinct words and their n."""
    sizes = words.select("word", "n", F.explode(F.array(F.length("word") - 1, F.length("word"))).alias("m"))
    waiting = stored(filed(halves(sizes, "0", "m + 1")), "spelling-keys")
    ready, total = [], 0
    while True:
        hot = stored(waiting.groupBy(*KEY).count().where((F.col("count") > group_rows) & (F.col("b") - F.col("a") > 1))
                     .select(*KEY), "spelling-hot")
        total += waiting.count()
        if hot.isEmpty():
            ready.append(waiting)
            break
        ready.append(waiting.join(hot, KEY, "left_anti").select(waiting.columns))
        waiting = stored(filed(halves(waiting.join(hot, KEY, "left_semi"), "a", "b")), "spelling-keys")
    every = ready[0]
    for more in ready[1:]:
        every = every.unionByName(more)
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (m, a, b, _), group in groupby(rows_of(batches), key=lambda r: r[:4]):
            held = [(r[4], r[5]) for r in group]
            for i, j in one_edit([w for w, _ in held], m):
                (left, n), (right, other_n) = held[i], held[j]
                if a <= len(commonprefix([left, right])) < b:
                    out += [(left, right, other_n), (right, left, n)]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # The number is given, for the work is far larger than the bytes by which partitions would be merged.
    return (every.select(*KEY, "word", "n").repartition(max(1, -(-total // task_rows)), *KEY)
            .sortWithinPartitions(*KEY, "word").mapInArrow(scan, "word string, near string, near_n long"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the end of their chain of forms. Each round doubles the steps."""
    reached = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = reached.select(F.col("word").alias("_at"), F.col("root").alias("_on"))
        step = stored(reached.join(onward, F.col("root") == F.col("_at"), "left")
                      .select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")),
                      "spelling-roots")
        reached = step.select("word", "root")
        if step.where("moved").isEmpty():
            return reached


def spelling_variants(words: DataFrame, ratio: int = RATIO, group_rows: int = GROUP_ROWS) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of (word, n)."""
    words = stored(words.select("word", "n"), "spelling-words")
    near = near_words(words, group_rows).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    largest = -F.col("best.minus")
    common = largest >= ratio * F.col("n")
    known = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("best.near")).alias("form"), F.when(common, largest).alias("form_n")), "spelling-forms")
    return (known.join(roots(known.where(F.col("form").isNotNull())), "word", "left")
            .withColumn("root", F.coalesce("root", "word")))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, folder, "documents"))).select(
        "word", "form", "root", "n", "n_near", "form_n")
