"""Benchmark decontamination with a generalised suffix automaton of the test items.

Spark deals the distinct items by hash into blocks of at most ``block_words`` words (an item beyond that stands alone), so
one automaton has a size bound whatever the size of the benchmark. Each block is one pass over the documents: its items
travel with the tasks, a Python process builds the automaton once, and every document streams its words through it,
tracking the longest suffix that is a passage of an item. Where that length reaches ``min_words``, or a whole shorter
item, the covered words are hit. Passes are jobs of their own: the hits of each, by the digest of the text, are written
to the shared folder before the next one starts, so driver and tasks hold one block at a time. A benchmark of one block
needs no digest and no join.

A removal takes the hit spans out of the text, or drops the document when its covered share exceeds ``max_coverage``.
Null and empty texts have no words and are never hit; items without words never occur; repeated rows are each judged;
an empty benchmark hits nothing. Columns beyond doc_id and text are kept and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import LOWER, NOT_WORD, UPPER, arrow_schema, map_slices, table, words_of
from tidemark.session import stored

MIN_WORDS = 10
BLOCK_WORDS = 500_000
CELLS = 16
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class SuffixAutomaton:
    """Suffix automaton of several word sequences; ``marks`` per state tell what a long enough match means."""

    def __init__(self, items: list[tuple[object, list[bytes]]], min_words: int = MIN_WORDS):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.min_words = min_words
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        # The state that holds exactly the passage of the last n words of a match: up the links while they are as long.
        # ``needed``: the least match length in this state that is a hit, and the passage length it covers.
        n = len(self.next)
        self.owners: dict[int, set] = {}
        self.whole: dict[int, list[int]] = {}
        short: dict[int, int] = {}
        for item, words in items:
            state = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                if i + 1 >= min_words:
                    self.owners.setdefault(self.holder(state, min_words), set()).add(item)
            if words and len(words) < min_words:
                self.owners.setdefault(state, set()).add(item)
                short[state] = len(words)
        # Short items that end a match: each state inherits those of the states its links lead to.
        order = sorted(range(n), key=self.length.__getitem__)
        for state in order[1:]:
            above = self.whole.get(self.link[state], [])
            own = [short[state]] if state in short else []
            if above or own:
                self.whole[state] = sorted({*above, *own})

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._split(last, word, known)
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at != -1 and word not in nxt[at]:
            nxt[at][word] = state
            at = link[at]
        if at != -1:
            known = nxt[at][word]
            link[state] = known if length[known] == length[at] + 1 else self._split(at, word, known)
        return state

    def _split(self, at: int, word: bytes, known: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[known]))
        self.link.append(self.link[known])
        self.length.append(self.length[at] + 1)
        self.link[known] = copy
        while at != -1 and self.next[at].get(word) == known:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def holder(self, state: int, n: int) -> int:
        """The state of the last ``n`` words of a match of at least ``n`` words in ``state``."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, set]]:
        """(first word, end, items) of every window that occurs, by its end."""
        nxt, link, length, n = self.next, self.link, self.length, self.min_words
        root, whole = nxt[0], self.whole
        state = matched = 0
        for i, word in enumerate(words):
            if matched:
                to = nxt[state].get(word)
                while to is None and state:
                    state = link[state]
                    matched = length[state]
                    to = nxt[state].get(word)
            else:
                to = root.get(word)
            if to is None:
                matched = 0
                continue
            state = to
            matched += 1
            if matched >= n:
                yield i + 1 - n, i + 1, self.owners[self.holder(state, n)]
            if state in whole:
                for size in whole[state]:
                    if size <= matched:
                        yield i + 1 - size, i + 1, self.owners[self.holder(state, size)]


def scan(machine: SuffixAutomaton, text: str | None) -> tuple[int, list[list[int]], set]:
    """Words of the text, the hit word spans (merged, end exclusive) and the items met."""
    words = words_of(text)
    spans: list[list[int]] = []
    found: set = set()
    for start, end, items in machine.matches(words):
        found |= items
        # Ends only grow, but a short item may start later than the window that ends with it.
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append([start, end])
    return len(words), spans, found


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, int]:
    """(block, item, text) of the distinct items with words, written to the shared folder, and the number of blocks.

    Items are dealt by hash into cells, ever more until each holds at most ``block_words`` words or a single item;
    neighbouring cells are then put together. The driver sees the sizes of cells only, about ``CELLS`` a block.
    """
    marked = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    rows = (items.select(F.col("item_id").cast("string").alias("item"), "text",
                         F.size(F.array_remove(F.split(marked, NOT_WORD, -1), "")).alias("n"))
            .where("n > 0").dropDuplicates(["item", "text"]))
    rows = stored(rows.withColumn("_at", F.xxhash64("item", "text")), "benchmark-items")
    total = rows.agg(F.sum("n")).first()[0] or 0
    cells = 1 if total <= block_words else CELLS * -(-total // block_words)
    while True:
        cell = F.pmod("_at", F.lit(cells))
        sizes = rows.groupBy(cell.alias("cell")).agg(F.sum("n").alias("n"), F.countDistinct("_at").alias("places")).collect()
        if all(r["n"] <= block_words or r["places"] == 1 for r in sizes):
            break
        cells *= 2
    starts, size = [0], 0
    for r in sorted(sizes, key=lambda r: r["cell"]):
        if size and size + r["n"] > block_words:
            starts.append(r["cell"])
            size = 0
        size += r["n"]
    block = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= cell)) - 1
    return stored(rows.select(block.alias("block"), "item", "text"), "benchmark-blocks"), len(starts)


def contamination(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS,
                  block_words: int = BLOCK_WORDS, keep_text: bool = True,
                  name: str = "contamination") -> DataFrame:
    """All rows and columns of ``docs`` with column ``name``: n_words, spans (word offsets) and items (sorted texts)."""
    dealt, blocks = item_blocks(items, block_words)
    if blocks == 1:
        return _last_block(docs, _sent(dealt, 0), min_words, name, keep_text, False)
    key = "_digest_of_text"
    texts = docs.select(F.md5("text").alias(key), "text").where("text IS NOT NULL")
    hits = None
    for block in range(blocks - 1):
        found = stored(_hits(texts, _sent(dealt, block), min_words, key).dropDuplicates([key]), "benchmark-hits")
        hits = found if hits is None else hits.union(found)
    # A text has at most one row a block here. Documents without text get keys that match nothing.
    known = hits.groupBy(key).agg(F.struct(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(
        F.flatten(F.collect_list("items"))).alias("items")).alias(name))
    joined = (docs.drop(name).withColumn(key, F.coalesce(F.md5("text"), F.concat(F.lit("null "), F.col("doc_id").cast("string")), F.lit("null")))
              .join(known, key, "left").drop(key))
    return _last_block(joined, _sent(dealt, blocks - 1), min_words, name, keep_text, True)


def _sent(dealt: DataFrame, block: int) -> tuple[str, Broadcast]:
    """One block of items for the tasks, with a name of its own."""
    rows = [(r["item"], words_of(r["text"])) for r in dealt.where(F.col("block") == block).collect()]
    return uuid4().hex, dealt.sparkSession.sparkContext.broadcast(rows)


_built: dict[tuple, SuffixAutomaton] = {}


def machine_of(sent: tuple[str, Broadcast], min_words: int) -> SuffixAutomaton:
    """The automaton of a block; a process keeps that of the last block it saw."""
    key = sent[0], min_words
    if key not in _built:
        _built.clear()
        _built[key] = SuffixAutomaton(sent[1].value, min_words)
    return _built[key]


def _hits(texts: DataFrame, sent: tuple[str, Broadcast], min_words: int, key: str) -> DataFrame:
    """The key, spans and items of the texts that hold a passage of one block."""
    schema = f"{key} string, spans array<array<int>>, items array<string>"

    def run(batch: dict) -> dict:
        machine = machine_of(sent, min_words)
        out: dict = {key: [], "spans": [], "items": []}
        for digest, text in zip(batch[key], batch["text"]):
            _, spans, items = scan(machine, text)
            if spans:
                out[key].append(digest)
                out["spans"].append(spans)
                out["items"].append(sorted(items))
        return out

    return map_slices(texts, run, schema)


def _last_block(docs: DataFrame, sent: tuple[str, Broadcast], min_words: int, name: str, keep_text: bool,
                known: bool) -> DataFrame:
    """Add the hits of the last block, united with those of earlier blocks where ``docs`` has them as ``name`` (``known``)."""
    kind = "struct<n_words:bigint,spans:array<array<int>>,items:array<string>>"
    left = {name} if keep_text else {name, "text"}
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name not in left)
    schema = f"{fields}`{name}` {kind}"
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            machine = machine_of(sent, min_words)
            texts = batch.column(batch.schema.get_field_index("text"))
            before = batch.column(batch.schema.get_field_index(name)).to_pylist() if known else [None] * len(texts)
            found = []
            for text, earlier in zip(texts, before):
                n, spans, items = scan(machine, text.as_py())
                if earlier:
                    spans = united(earlier["spans"] + spans)
                    items |= set(earlier["items"])
                found.append({"n_words": n, "spans": spans, "items": sorted(items)})
            columns = [batch.column(i).cast(target.field(f).type) for i, f in enumerate(batch.schema.names)
                       if f not in left]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, target.field(name).type)], schema=target)

    return docs.mapInArrow(run, schema)


def united(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def cut(text: str, spans: list[list[int]]) -> str:
    """The text without the words of the spans and what lies between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORD.finditer(raw)]
    kept, at = [], 0
    for first, end in spans:
        kept.append(raw[at:places[first][0]])
        at = places[end - 1][1]
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def decontaminated(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_coverage: float = 0.5,
                   block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without benchmark passages: spans are cut out; a document covered beyond ``max_coverage`` goes.

    ``n_chars``, where there is such a column, is that of the new text.
    """
    found = contamination(docs, items, min_words, block_words, name="_contamination")
    hit = F.aggregate("_contamination.spans", F.lit(0).cast("bigint"), lambda a, s: a + s[1] - s[0])
    kept = found.where(hit <= F.lit(max_coverage) * F.col("_contamination.n_words"))

    @F.pandas_udf("string")
    def cleaned(text, spans):
        return text.combine(spans, lambda t, s: cut(t, [list(x) for x in s]) if t is not None and len(s) else t)

    kept = kept.withColumn("text", F.when(F.size("_contamination.spans") > 0,
                                          cleaned("text", "_contamination.spans")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = F.size("_contamination.spans") > 0
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType))
                               .otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, folder, "benchmark"), keep_text=False)
    hit = F.aggregate("contamination.spans", F.lit(0).cast("bigint"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
