"""Quality scores: kernel ridge regression by random Fourier features, calibrated by isotonic regression.

Each document becomes a vector of statistics (character classes, word and line shapes, repetition). Random Fourier
features of the standardised vector approximate a Gaussian kernel; each partition sums its part of the normal
equations, the sums are added, and a ridge solution scores every document. Isotonic regression on other labelled
documents turns the raw score into a probability that never falls as the raw score rises.

The fit reads at most ``fit_rows`` labelled documents (by the order of a hash of the id); folds 1-3 fit, fold 4
calibrates, fold 0 is never read. All documents are scored, whole. Null and empty texts have statistics of zero and
are scored as such. Without labels of both kinds the score is the share of label 1, or 0.5 without any. Repeated rows
are each scored; of contradicting labels the larger counts.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import fold, map_rows, table, utf8
from tidemark.llm.toxicity import sample
from tidemark.session import stored

FIT_ROWS = 30_000
N_FEATURES = 200
RIDGE = 1e-3
WIDTH = 4.0
SEED = 7
SUMS = 8  # partitions that sum; what comes to the driver is this many square matrices

SYMBOLS = b"!#$%&*|.,;:?\"'()<>[]{}=+-_/\\@^~`"


def statistics(text: str | None) -> list[float]:
    raw = utf8(text)
    if not raw:
        return [0.0] * N_STATISTICS
    size = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lower, upper = int(counts[97:123].sum()), int(counts[65:91].sum())
    beyond, digits = int(counts[128:].sum()), int(counts[48:58].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    words = raw.split()
    n = max(len(words), 1)
    tally = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:])))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8) if words else np.zeros(1, np.uint8)
    odd_end = int(np.isin(ends, ODD_ENDS).sum())
    repeated_lines = len(lines) - len(set(lines))
    return [
        np.log1p(size), np.log1p(len(words)), lower / size, upper / size, beyond / size, digits / size,
        int(counts[[9, 10, 13, 32]].sum()) / size, int(counts[list(SYMBOLS)].sum()) / size,
        upper / max(lower + upper, 1), *[20 * int(counts[c]) / size for c in b"!#$%&*|."], float(counts[:9].sum()) / size,
        float(lengths.mean()) / 10, float(lengths.std()) / 10, len(tally) / n, max(tally.values(), default=0) / n,
        triples / max(len(words) - 2, 1) if len(words) > 2 else 1.0, odd_end / n,
        repeated_lines / max(len(lines), 1), np.log1p(size / max(len(lines), 1)), float(len(words) < 5)]


ODD_ENDS = np.frombuffer(b"!#$%&*|", np.uint8)
N_STATISTICS = 27


@dataclass
class Model:
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    directions: np.ndarray | None = None
    phases: np.ndarray | None = None
    weights: np.ndarray | None = None
    steps: np.ndarray = field(default_factory=lambda: np.zeros(1))      # raw scores of the calibration
    values: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))  # probabilities at these

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / N_FEATURES)
        return np.concatenate([waves, z, np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), float(self.values[0]))
        return np.interp(self.raw(stats), self.steps, self.values)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block means of y in the order of x, at the blocks' mean x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1.0, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            for i in range(3):
                blocks[-1][i] += last[i]
    steps = np.array([b[2] / b[1] for b in blocks])
    return steps, np.array([b[0] / b[1] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    texts = sample(docs, labels, label, fit_rows)
    stats = stored(map_rows(texts, lambda b: {"label": b["_label"], "fold": b["_fold"],
                                              "stats": [list(map(float, statistics(t))) for t in b["text"]]},
                            "label int, fold int, stats array<double>"), "quality-statistics")
    model = Model()
    held = stats.where("fold = 4")
    # Mean and spread of each statistic over the fitted rows, by Spark.
    of = [F.col("stats")[i] for i in range(N_STATISTICS)]
    row = stats.agg(F.count("*").alias("n"), F.avg("label").alias("share"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(of)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(of)]).first()
    if row["share"] is not None:
        model.values = np.full(1, float(row["share"]))
    if not row["n"] or row["share"] in (0.0, 1.0):
        return model
    model.mean = np.array([row[f"m{i}"] for i in range(N_STATISTICS)])
    model.scale = np.array([row[f"s{i}"] or 1.0 for i in range(N_STATISTICS)]) + 1e-9
    rng = np.random.default_rng(SEED)
    model.directions = rng.normal(0, 1 / WIDTH, (N_STATISTICS, N_FEATURES))
    model.phases = rng.uniform(0, 2 * np.pi, N_FEATURES)
    shared = stats.sparkSession.sparkContext.broadcast(model)
    size = N_FEATURES + N_STATISTICS + 1

    def sums(batches):
        import pyarrow as pa

        left, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, N_STATISTICS)
            z = shared.value.features(x)
            left += z.T @ z
            right += z.T @ np.array(batch.column(0).to_pylist(), dtype=float)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([np.vstack([left, right]).tobytes()], pa.binary())})

    parts = stats.where("fold < 4").select("label", "stats").coalesce(SUMS).mapInArrow(sums, "sums binary").collect()
    total = sum((np.frombuffer(r["sums"]).reshape(size + 1, size) for r in parts), np.zeros((size + 1, size)))
    n = max(total[-2, -1], 1.0)
    ridge = RIDGE * n * np.diag([1.0] * (size - 1) + [1e-6])
    model.weights = np.linalg.solve(total[:-1] + ridge, total[-1])
    rows = held.select("label", "stats").collect()  # at most fit_rows rows of numbers
    if len({r["label"] for r in rows}) == 2:
        raw = model.raw(np.array([r["stats"] for r in rows]))
        model.steps, model.values = isotonic(raw, np.array([r["label"] for r in rows], dtype=float))
    else:
        model.steps, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: dict) -> dict:
        stats = np.array([statistics(t) for t in batch["text"]], dtype=float).reshape(-1, N_STATISTICS)
        return {"doc_id": batch["doc_id"], "score": np.clip(shared.value.score(stats), 0, 1).tolist()}

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, folder, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"))
