"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are complete and flattened into arrays (feature, bin and leaf value by node), so that numpy walks
all rows of a batch through a tree at once.  Fitted on a bounded sample (SAMPLE labelled rows) whose
crc32(doc_id) modulo 5 isn't 0; only the statistics of the whole text enter a score.

Nulls: a null text scores as an empty one.  Rows whose label is null are not learned from.  Empty tables
give empty results; with nothing to learn from the score is the base rate, or 0.5.  Repeated rows score
alike; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bucket, column_bytes, pieces
from touchline.llm.docstats import COUNTS, RATIOS, text_stats
from touchline.llm.quality_rules import labelled_stats

SAMPLE, TREES, DEPTH, BINS, RATE = 12000, 80, 4, 48, 0.15
#: Score from which a document is predicted good.
CUT = 0.3


class BoostedTrees:
    """Logistic boosting on histograms."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: float = 4.0):
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.start, self.depth = float(np.log(share / (1 - share))), depth
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if len(y) else []
        inner, leaves = 2**depth - 1, 2**depth
        self.feature = np.zeros((trees if len(y) else 0, inner), np.int64)
        self.cut = np.full(self.feature.shape, bins + 1, np.int64)
        self.value = np.zeros((len(self.feature), leaves))
        if not len(y):
            return
        b, margin, rows = self.binned(x), np.full(len(y), self.start), np.arange(len(y))
        for t in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, curve = p - y, p * (1 - p) + 1e-6
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                best, gain = np.zeros(width, np.int64), np.zeros(width)
                where = np.full(width, bins + 1)
                for f in range(b.shape[1]):
                    key = (node - first) * (bins + 1) + b[:, f]
                    g, h = (np.cumsum(np.bincount(key, w, width * (bins + 1)).reshape(width, -1), axis=1) for w in (grad, curve))
                    total_g, total_h = g[:, -1:], h[:, -1:]
                    win = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                    win[(h < least / 4) | (total_h - h < least / 4)] = 0
                    at = win.argmax(axis=1)
                    better = win[np.arange(width), at] > gain + 1e-9
                    gain[better], best[better], where[better] = win[np.arange(width), at][better], f, at[better]
                self.feature[t, first : first + width], self.cut[t, first : first + width] = best, where
                node = 2 * node + 1 + (b[rows, self.feature[t, node]] > self.cut[t, node])
            leaf = node - inner
            g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, curve, leaves)
            self.value[t] = -rate * g / (h + 1)
            margin += self.value[t, leaf]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        margin = np.full(len(x), self.start)
        if len(self.feature):
            b, rows = self.binned(x), np.arange(len(x))
            for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
                node = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
                margin += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-margin))


def features(stats: np.ndarray) -> np.ndarray:
    """What the trees see: the number of words on a log scale, and the ratios."""
    return np.column_stack([np.log1p(stats[:, 0]), stats[:, 5:]])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BoostedTrees:
    stats, y = labelled_stats(docs, labels.where(bucket(F.col("doc_id"), 5) != 0), "quality", sample)
    return BoostedTrees(features(stats) if len(y) else np.zeros((0, 1)), (y == 1).astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, held_out, score and predicted."""
    model = fit_quality(docs, labels, sample)

    def run(batches):
        for batch in pieces(batches):
            stats = np.array([text_stats(x) for x in column_bytes(batch, "text")]).reshape(batch.num_rows, len(COUNTS) + len(RATIOS))
            score = model.score(features(stats))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
