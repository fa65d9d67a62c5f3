"""Quality classifier: histogram gradient-boosted trees over document statistics.

Training happens on the driver over a bounded sample of labelled rows (TRAIN_ROWS, the ones with the
smallest hash of their doc_id): features are binned into at most BINS quantile bins, each level of a
tree sums gradients in histograms, and trees grow by second-order gain on logistic loss. The trees
are flattened into arrays, so all trees take one step of a batch at a time in numpy.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.arrow import arrow_map
from lodestar.llm.quality_rules import base_counts, histograms
from lodestar.llm.words import spans, word_hashes

TRAIN_ROWS, TREES, DEPTH, BINS, RATE, L2, LEAST_ROWS = 20_000, 60, 4, 32, 0.15, 1.0, 5
#: The probability from which a document is predicted good.
THRESHOLD = 0.7


def features(text: str | None) -> list[float]:
    """Statistics of one text; labels, lang, source and doc_id are no part of them."""
    text = text or ""
    n, chars, symbols, dup_lines, repeated = base_counts(text)
    classes, common = histograms(text)
    digits = sum(map(text.count, "0123456789"))
    data = text.encode()
    starts, ends = spans(data)
    distinct = len(np.unique(word_hashes(data)))
    longest = int((ends - starts).max()) if n else 0
    lines = text.count("\n") + 1
    size, w = max(1, len(text)), max(1, n)
    share = classes / size
    return [
        np.log1p(n), chars / w, symbols / w, dup_lines / lines, repeated / w, *share.tolist(), digits / size,
        1 - common[-1] / w, int((common[:-1] > 0).sum()) / w, common.max() / w, distinct / w, longest, n / lines,
        text.count("!") / w, text.count("|") / w, text.count("?") / w, text.count("@") / w,
    ]


WIDTH = len(features(""))


@dataclass(frozen=True)
class Forest:
    """All trees in arrays of one row a tree; node k has the children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        if not len(self.value):
            return np.full(len(x), 1 / (1 + np.exp(-self.start)))
        trees, rows = np.arange(len(self.value))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.value)), dtype=np.int64)
        for _ in range(DEPTH):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.limit[trees, at])
        return 1 / (1 + np.exp(-(self.start + self.value[trees, at - (2**DEPTH - 1)].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boosts trees on features x and labels y (0 or 1)."""
    n = len(y)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    mean = min(max((y.sum() + 0.5) / (n + 1), 1e-3), 1 - 1e-3)
    start = float(np.log(mean / (1 - mean)))
    if not n or y.min() == y.max():
        return Forest(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    feature, limit, value = (np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    score = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for depth in range(DEPTH):
            base, width = 2**depth - 1, 2**depth
            best = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                key = (node - base) * BINS + bins[:, j]
                sums = [np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h, None)]
                (gl, hl, cl), (ga, ha, ca) = sums, [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + L2) + (ga - gl) ** 2 / (ha - hl + L2) - ga**2 / (ha + L2)
                gain[(cl < LEAST_ROWS) | (ca - cl < LEAST_ROWS)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(axis=1)
                won = gain[np.arange(width), k] > best
                best[won] = gain[np.arange(width), k][won]
                feature[t, base : base + width][won] = j
                limit[t, base : base + width][won] = edges[j][np.minimum(k, len(edges[j]) - 1)][won] if len(edges[j]) else np.inf
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > limit[t, node])
        leaf = node - inner
        gsum, hsum = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value[t] = RATE * gsum / (hsum + L2)
        score += value[t][leaf]
    return Forest(feature, limit, value, start)


def is_held_out(doc_id: int | None) -> bool:
    """Whether labels of this document are out of bounds; a null id is read as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 4 == 2


def _features(docs: DataFrame) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "x": [features(t) for t in batch.column("text").to_pylist()]}

        return step

    return arrow_map(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), make, "doc_id bigint, x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """A model of labels.quality, from at most `rows` labelled documents that are not held out."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    able = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc != 2)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    some = able.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = docs.select("doc_id", "text").join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")  # at most `rows` ids
    each = _features(known).groupBy("doc_id").agg(F.min("x").alias("x"))  # of several rows of an id the one with the smallest statistics
    got = each.join(F.broadcast(some), "doc_id").orderBy("doc_id").toArrow()
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, WIDTH)
    return fit(x, got["y"].to_numpy().astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, keep_text: bool = False) -> DataFrame:
    """The columns of docs (text only if asked for), with held_out, score and predicted.

    docs: doc_id, text and any others; labels: doc_id, quality. score is the probability of label 1,
    for empty and null texts too (they have the statistics of no words). predicted is 1 from
    THRESHOLD on. Labels other than 0 and 1 are ignored, and of several for a document the lowest
    counts; without labels of both kinds every score is the labels' share of ones (0.5 without any).
    Repeated rows each keep their row; an empty table gives an empty result.
    """
    added = ["held_out", "score", "predicted"]
    forest = train(docs, labels, rows)
    docs = docs.drop(*added).withColumns({"text": F.col("text").cast("string"), "doc_id": F.col("doc_id").cast("bigint")})
    others = [c for c in docs.columns if keep_text or c != "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "held_out boolean, score double, predicted int"])

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            scores = forest.scores(np.array([features(t) for t in batch.column("text").to_pylist()], dtype=float).reshape(-1, WIDTH))
            held = [is_held_out(i) for i in batch.column("doc_id").to_pylist()]
            return {c: batch.column(c) for c in others} | {"held_out": held, "score": scores, "predicted": (scores >= THRESHOLD).astype(np.int32)}

        return step

    return arrow_map(docs, make, schema)
