"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values.

1. Counts. Documents with each word, and with each prefix of 3, 4 and 6 bytes, are counted per label in Spark.
2. Log-odds with Dirichlet priors. A unit's toxic share is its counts plus ``PRIOR`` pseudo-counts at the share of its
   parent (word, prefix of 6, 4, 3, base rate); its score is the log-odds against the base rate, brought nearer to 0 by
   ``SURE`` standard errors, less ``DRIFT``. Unknown words
   take the score of their longest known prefix.
3. Segments. One linear scan finds all maximal-scoring segments of a document.
4. Extreme values. On clean documents the largest segment score of n words follows a Gumbel law whose location grows
   with log n. ``lam`` and ``log_k`` are fitted by moments; a segment's reduced score is lam * S - log(K n). A document
   sums the reduced scores of its significant segments, or takes the largest if none is; a logistic curve fitted on
   other documents maps this to a probability.

The model learns from a bounded sample, ``fit_rows`` labelled documents by the order of a hash of their id; folds 1-3
count, fold 4 calibrates, fold 0 is never read. All documents are scored, whole. Null and empty texts have no segment
and get the probability of score 0. Without labels of both kinds every score is 0. Repeated rows are each scored; of
contradicting labels of one document the larger counts. Further columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import (arrow_schema, bound_batches, byte_slices, fold, map_rows, min_hashes, seeds, shingle_hashes,
                                 table, words_of)
from tidemark.session import stored

FIT_ROWS = 30_000
PREFIXES = (6, 4, 3)
PRIOR = 8.0
MIN_COUNT = 4
SURE = 2.5
DRIFT = 0.7
P_VALUE = 0.05


@dataclass
class Model:
    scores: dict[bytes, float] = field(default_factory=dict)   # units that differ from their parent
    unknown: float = -DRIFT
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -math.inf


class Scores(dict):
    """Word scores with back-off to prefixes; forgets everything when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: bytes) -> float:
        known = self.model.scores
        score = next((known[u] for u in units(word) if u in known), self.model.unknown)
        if len(self) > 200_000:
            self.clear()
        self[word] = score
        return score


def units(word: bytes) -> list[bytes]:
    """The word, then its prefixes from long to short; a marker keeps prefixes apart from words."""
    return [word, *(b"^" + word[:n] for n in PREFIXES if len(word) >= n)]


def segments(values: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end) of a sequence, in linear time.

    Positive stretches come in one by one with the running totals before and after them. A stretch joins the nearest
    earlier segment that starts lower, if that one also ends lower; pointers to the nearest lower start make it linear.
    """
    positive = values > 0
    if not positive.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], positive, [False])).astype(np.int8)))
    totals = np.concatenate(([0.0], np.cumsum(values)))
    found: list[tuple[float, float, int, int, int]] = []  # total before, after, start, end, nearest with lower start
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        low, high = float(totals[start]), float(totals[end])
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][0] >= low:
                at = found[at][4]
            if at < 0 or found[at][1] >= high:
                break
            low, start = found[at][0], found[at][2]
            del found[at:]
            at = len(found) - 1
        found.append((low, high, start, end, at))
    return [(high - low, start, end) for low, high, start, end, _ in found]


def reduced(model: Model, score: float, n: int) -> float:
    return model.lam * score - model.log_k - math.log(max(n, 1))


def strength(model: Model, found: list[tuple[float, int, int]], n: int) -> float:
    """Sum of the reduced scores of the significant segments; else the largest, which is below the threshold."""
    least = -math.log(-math.log1p(-P_VALUE))
    each = [reduced(model, s, n) for s, _, _ in found] or [reduced(model, 0.0, n)]
    over = [x - least for x in each if x >= least]
    return least + sum(over) if over else max(each)


def probability(model: Model, x: float) -> float:
    z = model.slope * x + model.offset
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def sample(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> DataFrame:
    """Texts, labels and folds of the first ``fit_rows`` labelled documents outside fold 0, less near copies.

    At most ``fit_rows`` ids are broadcast, and as many texts are stored; the size bound is that parameter. A group of
    near copies would teach its own rare words, so of the sampled documents that share a min-hash of word triples, under
    any of four hash functions, one stays.
    """
    chosen = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
              .where(fold(F.col("doc_id")) != 0)
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .withColumn("_fold", fold(F.col("doc_id")).cast("int")))
    multipliers = seeds(4, 9)

    def signed(batch: dict) -> dict:
        found = []
        for text in batch["text"]:
            hashes = shingle_hashes(words_of(text), 3)
            found.append(min_hashes(hashes, multipliers).astype(np.int64).tolist() if len(hashes) else [0] * 4)
        return batch | {f"_h{i}": [f[i] for f in found] for i in range(4)}

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    texts = stored(map_rows(rows, signed, f"{kinds}, _h0 long, _h1 long, _h2 long, _h3 long"), "fit-sample")
    kept = texts.drop("text")
    for i in range(4):
        first = kept.groupBy(f"_h{i}").agg(F.min("doc_id").alias("doc_id"))
        kept = kept.join(first, [f"_h{i}", "doc_id"], "left_semi")
    return texts.select("doc_id", "text", "_label", "_fold").join(kept.select("doc_id"), "doc_id", "left_semi").drop("doc_id")


def count_units(texts: DataFrame) -> DataFrame:
    """Documents with each unit by label, reduced within each batch and again by Spark; the unit '' counts documents."""

    def run(batch: dict) -> dict:
        counts: dict[bytes, list[int]] = {}
        for text, label in zip(batch["text"], batch["_label"]):
            for unit in {u for w in set(words_of(text)) for u in units(w)} | {b""}:
                counts.setdefault(unit, [0, 0])[label] += 1
        return {"unit": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]}

    rows = map_rows(texts.select("text", F.when(F.col("_label") > 0, 1).otherwise(0).alias("_label")), run,
                    "unit binary, clean long, toxic long")
    return rows.groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def log_odds(counts: DataFrame) -> tuple[dict[bytes, float], float]:
    """Scores of the units in ``MIN_COUNT`` documents and lean to either side, and the base share.

    What comes to the driver is bounded by the fitted sample: units in fewer documents stay behind.
    """
    rows = {bytes(r["unit"]): (r["clean"], r["toxic"])
            for r in counts.where(F.col("clean") + F.col("toxic") >= MIN_COUNT).toLocalIterator()}
    if b"" not in rows:
        return {}, 0.5
    clean, toxic = rows.pop(b"")
    base = (toxic + 1) / (clean + toxic + 2)
    logit = lambda p: math.log(p / (1 - p))
    share: dict[bytes, float] = {}

    def estimate(unit: bytes) -> float:
        if unit in share:
            return share[unit]
        if unit[:1] == b"^":
            shorter = next((b"^" + unit[1:1 + n] for n in PREFIXES if n < len(unit) - 1), None)
        else:
            shorter = next((u for u in units(unit)[1:] if u in rows), None)
        prior = estimate(shorter) if shorter in rows else base
        c, t = rows[unit]
        share[unit] = (t + PRIOR * prior) / (c + t + PRIOR)
        return share[unit]

    scores = {}
    for unit, (c, t) in rows.items():
        lean = logit(estimate(unit)) - logit(base)
        sure = SURE * math.sqrt(1 / (t + PRIOR * base) + 1 / (c + PRIOR * (1 - base)))
        lean = math.copysign(max(0.0, abs(lean) - sure), lean)
        scores[unit] = max(-3.0, min(lean - DRIFT, 8.0))
    # A unit with the score of what it backs off to is not needed.
    return {u: s for u, s in scores.items()
            if abs(s - next((scores[p] for p in parents(u) if p in scores), -DRIFT)) > 0.05}, base


def parents(unit: bytes) -> list[bytes]:
    if unit[:1] == b"^":
        return [b"^" + unit[1:1 + n] for n in PREFIXES if n < len(unit) - 1]
    return units(unit)[1:]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    texts = stored(sample(docs, labels, label, fit_rows), "toxicity-sample")
    model = Model()
    model.scores, _ = log_odds(count_units(texts.where("_fold < 4")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def largest(batch: dict) -> dict:
        scores = Scores(shared.value)
        out = {"label": batch["_label"], "n": [], "found": []}
        for text in batch["text"]:
            words = words_of(text)
            found = segments(np.array([scores[w] for w in words]))
            out["n"].append(len(words))
            out["found"].append([s for s, _, _ in found])
        return out

    rows = map_rows(texts.where("_fold = 4"), largest, "label int, n long, found array<double>").collect()
    clean = [(max(r["found"], default=0.0), max(r["n"], 1)) for r in rows if r["label"] == 0]
    if len(clean) < 2 or len(clean) == len(rows) or not model.scores:
        return model
    # Gumbel moments of S less the growth of its location: S = (log K + log n + G) / lam.
    best, logs = np.array([s for s, _ in clean]), np.log([n for _, n in clean])
    lam = 1.0
    for _ in range(50):
        spread = float(np.std(best - logs / lam))
        lam = 0.5 * lam + 0.5 * min(5.0, max(0.2, math.pi / math.sqrt(6) / max(spread, 1e-6)))
    model.lam, model.log_k = lam, float(np.mean(lam * best - logs)) - 0.5772156649
    x = np.array([strength(model, [(s, 0, 0) for s in r["found"]], r["n"]) for r in rows])
    model.slope, model.offset = logistic(x, np.array([r["label"] for r in rows], dtype=float))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge, on standardised input."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    design = np.stack([(x - mean) / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    ridge = np.diag([1e-2, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge,
                               design.T @ (p - y) + ridge @ beta)
        size = float(np.abs(step).max())
        beta -= step / max(1.0, size / 2)
        if size < 1e-8:
            break
    slope = max(0.0, float(beta[0])) / scale
    return slope, float(beta[1]) - slope * mean


def scored(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns, the score, and the significant passages (word offsets, p-value); ``prefix`` names these two.

    Kept columns pass as they came, and texts are read a few megabytes at a time, so memory does not follow their length.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [*keep] if "text" in keep else [*keep, "text"]
    rows = docs.select(*columns)
    at, kept = columns.index("text"), list(range(len(keep)))
    added = f"`{prefix}score` double, `{prefix}passages` array<struct<first:int,end:int,p:double>>"
    schema = StructType([*(rows.schema[i] for i in kept), *StructType.fromDDL(added)])
    kinds = [f.type for f in arrow_schema(docs.sparkSession, added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        scores = Scores(known)
        for batch in batches:
            for part in byte_slices(batch):
                values, passages = [], []
                for row in range(part.num_rows):
                    words = words_of(part.column(at)[row].as_py())
                    found = segments(np.array(list(map(scores.__getitem__, words))))
                    n = len(words)
                    values.append(probability(known, strength(known, found, n)))
                    risky = [(-math.expm1(-math.exp(-reduced(known, s, n))), a, b) for s, a, b in found]
                    passages.append([{"first": a, "end": b, "p": p} for p, a, b in risky if p <= P_VALUE])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in kept), pa.array(values, kinds[0]), pa.array(passages, kinds[1])], names=schema.names)

    return rows.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, folder, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      F.size("passages").alias("n_passages"))
