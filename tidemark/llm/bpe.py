"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

Encoding streams: the text is cut into pieces by the vocabulary's splitting pattern, a piece that was met before comes
from a bounded cache, and a long piece runs through ``Encoder.stream``: a window of bytes is merged, and tokens that end
at least ``lookahead`` bytes before the window's end are emitted, for no later byte can change them. The lookahead is
computed from the merge list. Decoding feeds token bytes one by one into an incremental UTF-8 decoder.

Null text counts as empty: no tokens and the hash of nothing. Empty tables give empty results; repeated rows are each
encoded; further columns of the input are ignored by :func:`encoded` and kept by :func:`with_round_trip`.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import map_rows, table

SEGMENT = 1 << 16      # characters split into pieces at a time
CACHE = 800_000        # pieces remembered by a task's process
LONG_PIECE = 256       # bytes; longer pieces are streamed and not remembered
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes beyond a token's end after which nothing can change the token.

    A merge of (u, v) can be prevented from the right only by an earlier merge that takes the last part of v as its
    left side while that part still stands alone; whether that one happens may hang on an even earlier one. The
    longest such chain, each link counted with the bytes of its merge, bounds how far right a decision looks.
    """
    rank = {a + b: i for i, (a, b) in reversed(list(enumerate(merges)))}
    starts: dict[bytes, tuple[list[int], list[int]]] = {}  # left side -> ranks, longest chain up to each

    def longest(left: bytes, before: int) -> int:
        ranks, best = starts.get(left, ([], []))
        lo, hi = 0, len(ranks)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if ranks[mid] < before else (lo, mid)
        return best[lo - 1] if lo else 0

    most = 0
    for i, (a, b) in enumerate(merges):
        part, until, chain = b, i, 0
        while True:
            chain = max(chain, longest(part, until))
            if len(part) == 1 or part not in rank:
                break
            until = min(until, rank[part])
            part = merges[rank[part]][1]
        reach = len(a) + len(b) + chain
        ranks, best = starts.setdefault(a, ([], []))
        ranks.append(i)
        best.append(max(reach, best[-1] if best else 0))
        most = max(most, reach)
    return most


class Encoder:
    """Encoder and decoder of one byte-level vocabulary file (content given as text)."""

    def __init__(self, content: str):
        data = json.loads(content)
        letters = byte_letters()
        raw = {c: b for b, c in enumerate(letters)}
        as_bytes = lambda token: (bytes(raw[c] for c in token) if all(c in raw for c in token)
                                  else token.encode())
        vocab = {as_bytes(k): v for k, v in data["model"]["vocab"].items()}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in data["model"]["merges"]]
        merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        # A pair of ids, packed, gives rank and merged id, packed: the least value is the pair to merge first.
        self.merge = {vocab[a] << 20 | vocab[b]: i << 20 | vocab[a + b] for i, (a, b) in enumerate(merges)}
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.lookahead = sufficient_lookahead(merges)
        self.window = 4 * self.lookahead
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_pattern = (re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
                                           + ")") if self.special else None)
        self.token_bytes = {i: t for t, i in vocab.items()} | {i: as_bytes(t) for t, i in self.special.items()}
        self.text_bytes = {str(i): t for i, t in self.token_bytes.items()}
        self.split_any = regex.compile(SPLIT)
        self.split_latin, self.beyond_latin = latin_splitter()
        self.pieces = PieceCache(self)

    def merged(self, data: bytes) -> list[int]:
        """The ids of ``data``: always the pair of lowest rank first, the leftmost of equals."""
        ids = [self.byte_ids[b] for b in data]
        get, none, mask = self.merge.get, 1 << 60, (1 << 20) - 1
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) != none:
            i = ranks.index(low)
            ids[i] = low & mask
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
        return ids

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that arrives in chunks, each emitted once no later byte can change it."""
        held = b""
        for chunk in data:
            held += chunk
            while len(held) >= self.window:
                out, at = [], 0
                for token in self.merged(held[:self.window]):
                    end = at + len(self.token_bytes[token])
                    if end > self.window - self.lookahead:
                        break
                    out.append(token)
                    at = end
                if not at:
                    break
                yield from out
                held = held[at:]
        yield from self.merged(held)

    def piece_ids(self, piece: str) -> str:
        data = piece.encode("utf-8", "surrogatepass")
        if len(data) <= self.window:
            tokens = self.merged(data)
        else:
            tokens = self.stream(data[i:i + self.window] for i in range(0, len(data), self.window))
        return ",".join(map(str, tokens))

    def encode(self, text: str | None) -> str:
        """Decimal ids joined by commas."""
        out: list[str] = []
        parts = [text or ""]
        if self.special_pattern and any(s in parts[0] for s in self.special):
            parts = self.special_pattern.split(parts[0])
        for part in parts:
            if part in self.special:
                out.append(str(self.special[part]))
                continue
            for segment in segments(part):
                split = self.split_any if self.beyond_latin(segment) else self.split_latin
                out.extend(map(self.pieces.__getitem__, split.findall(segment)))
        return ",".join(out)

    def decode_stream(self, ids: Iterable[str]) -> Iterator[str]:
        """Text in steps: bytes of an unfinished character wait for the next token."""
        decoder, rest = codecs.getincrementaldecoder("utf-8")("replace"), iter(ids)
        while step := list(islice(rest, 4096)):
            yield decoder.decode(b"".join(map(self.text_bytes.__getitem__, step)))
        yield decoder.decode(b"", final=True)

    def decode(self, ids: str) -> str:
        return "".join(self.decode_stream(ids.split(","))) if ids else ""


class PieceCache(dict):
    """Ids of pieces already met; emptied when full, so that memory stays constant."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> str:
        ids = self.encoder.piece_ids(piece)
        if len(piece) <= LONG_PIECE:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


def segments(text: str) -> Iterator[str]:
    """Slices that end before white space which follows something else: no piece spans such a place."""
    at, cut = 0, re.compile(r"(?<=[^\s\x1c-\x1f])[\t\n\r ]")
    while len(text) - at > SEGMENT:
        found = cut.search(text, at + SEGMENT)
        if not found:
            break
        yield text[at:found.start()]
        at = found.start()
    if at < len(text):
        yield text[at:] if at else text


def latin_splitter():
    """The splitting pattern with explicit classes, for texts of code points below U+0250 (about twice as fast)."""
    kinds: dict[str, list[str]] = {"L": [], "N": [], "S": [], "O": []}
    for c in map(chr, range(0x250)):
        kind = unicodedata.category(c)[0]
        space = regex.match(r"\s", c) is not None
        kinds["S" if space else kind if kind in "LN" else "O"].append(re.escape(c))
    letters, numbers, spaces, others = ("".join(kinds[k]) for k in "LNSO")
    pattern = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[{others}]+"
               rf"|[{spaces}]+(?![^{spaces}])|[{spaces}]+")
    beyond = re.compile("[^\x00-ɏ]")
    return re.compile(pattern), lambda text: not text.isascii() and beyond.search(text) is not None


@lru_cache(maxsize=2)
def encoder(content: str) -> Encoder:
    return Encoder(content)


def read_vocabulary(spark: SparkSession, path: str | None = None) -> str:
    """The vocabulary file's text (a few MB at most; its size is checked), sent along with the tasks."""
    with open(path or default_path(), encoding="utf-8") as file:
        content = file.read()
    if len(content) > 64 << 20:
        raise ValueError("vocabulary file above 64 MB")
    return content


def with_round_trip(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, then ids (text), n_tokens and the decoded text of every document."""
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(docs.sparkSession, path))
    rows = docs.select(*keep, F.col("text").alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")

    def run(batch: dict) -> dict:
        coder = encoder(content.value)
        ids = [coder.encode(t) for t in batch["_text"]]
        return {k: batch[k] for k in keep} | {
            "ids": ids, "n_tokens": [i.count(",") + 1 if i else 0 for i in ids], "decoded": list(map(coder.decode, ids))}

    return map_rows(rows, run, f"{kinds}, ids string, n_tokens long, decoded string")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Token count and hashes of ids and decoded text; hashing next to encoding, so ids never leave the task."""
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(docs.sparkSession, path))

    def digest(data: str) -> str:
        return hashlib.sha256(data.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batch: dict) -> dict:
        coder = encoder(content.value)
        out = {"doc_id": batch["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in batch["text"]:
            ids = coder.encode(text)
            out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
            out["ids_sha256"].append(digest(ids))
            out["decoded_sha256"].append(digest(coder.decode(ids)))
        return out

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run,
                    "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"))
