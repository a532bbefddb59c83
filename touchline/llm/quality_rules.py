"""Quality rules: exact rule statistics of each text and an isolation forest over them.

The forest is grown without labels; its trees hold PER_TREE labelled documents each, as the method has it (see grown()).  The score
beyond which a document is anomalous is set by all labels, each half of them scored by a forest that was grown from the other half alone.
Statistics cover every whole text.

Nulls: a null text counts as empty (all statistics 0, base_failed).  A null id is kept as it is.
Empty tables give empty results; without usable labelled rows the forest rejects nothing.
Repeated rows are judged alike, each for itself; of several texts with one id the one with the least hash is learned from.
Ties: a score equal to the threshold is kept.  Very long texts are read whole, in batches of bounded bytes.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import BROADCAST_IDS, bounded_sample, column_bytes, pieces, small_batches, staged
from touchline.llm.docstats import COUNTS, RATIOS, text_stats

TREES, PER_TREE, DEPTH = 100, 256, 8
#: The ratios that the forest splits on: rules of junk, none of which goes with a language or a kind of content.
RULES = [len(COUNTS) + RATIOS.index(x) for x in ("symbols", "pipes", "upper", "stops", "marks", "word_length", "repeats", "distinct")]
#: Share of the good labelled documents that a threshold may reject.
GOOD_LOST = 0.005
#: Steps of a score, from 0 to 1, in which scores are counted for the threshold.
STEPS = 1_000_000


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.maximum(np.asarray(n, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, n - 1)


class IsolationForest:
    """Trees as flat arrays: node k has the children 2k+1 and 2k+2; feature -1 marks a leaf with its path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, depth: int = DEPTH, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.size, self.depth = min(per_tree, len(rows)), depth
        self.feature = np.full((trees, 2 ** (depth + 1) - 1), -1, np.int32)
        self.cut = np.zeros(self.feature.shape)
        self.path = np.zeros(self.feature.shape)
        for t in range(trees):
            todo = [(0, 0, rows[draw.choice(len(rows), self.size, replace=False)])]
            while todo:
                node, level, x = todo.pop()
                spread = np.flatnonzero(np.ptp(x, axis=0) > 0) if len(x) > 1 else []
                if level == depth or not len(spread):
                    self.path[t, node] = level + average_path(len(x))
                    continue
                f = int(draw.choice(spread))
                cut = draw.uniform(x[:, f].min(), x[:, f].max())
                self.feature[t, node], self.cut[t, node] = f, cut
                below = x[:, f] <= cut
                todo += [(2 * node + 1, level + 1, x[below]), (2 * node + 2, level + 1, x[~below])]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; the shorter the paths to a row, the higher."""
        total = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (rows[at, f] > cut[node]))
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(float(average_path(self.size)), 1e-9))


def base_failed(counts: np.ndarray) -> np.ndarray:
    """The fixed rules: under 50 words, or over half of the words in repeated windows."""
    words, again = counts[:, 0], counts[:, 4]
    return (words < 50) | (100 * again > 50 * words)


def stats_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and an array of the COUNTS and RATIOS of its text."""

    def run(batches):
        for batch in pieces(batches):
            stats = [text_stats(x) for x in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


def labelled_stats(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The statistics and labels of a bounded sample of labelled documents (of an id with several labels, the least)."""
    small_batches(docs.sparkSession)
    keys = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    chosen = bounded_sample(keys.groupBy("doc_id").agg(F.min("label").alias("label")), "doc_id", most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    one = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = stats_of(one).join(F.broadcast(chosen), "doc_id").toPandas().sort_values("doc_id")
    return np.array(rows["stats"].tolist(), float).reshape(len(rows), len(COUNTS) + len(RATIOS)), rows["label"].to_numpy(int)


def labelled_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label, half (0 or 1) and RULES of every labelled document that passes the base rules (of an id with several labels, the least)."""
    small_batches(docs.sparkSession)
    keys = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    keys = staged(keys.groupBy("doc_id").agg(F.min("label").alias("label")))
    small = keys.count() <= BROADCAST_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(keys) if small else keys, "doc_id")

    def run(batches):
        for batch in pieces(batches):
            stats = np.array([text_stats(x) for x in column_bytes(batch, "text")]).reshape(batch.num_rows, len(COUNTS) + len(RATIOS))
            ok = np.flatnonzero(~base_failed(stats))
            kept = batch.take(pa.array(ok, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("doc_id"), kept.column("label"), kept.column("text_hash"), pa.array(list(stats[ok][:, RULES]), pa.list_(pa.float64()))], ["doc_id", "label", "text_hash", "ratios"])

    rows = texts.select("doc_id", "label", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, label int, text_hash long, ratios array<double>")
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct("label", "ratios"), "text_hash").alias("x"))
    return staged(one.select("doc_id", "x.label", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(2)).alias("half"), "x.ratios"))


def grown(rows: DataFrame) -> IsolationForest | None:
    """A forest whose trees have PER_TREE rows each, the method's own subsamples: they draw them from as many rows as all trees hold, those of the least hashes."""
    drawn = bounded_sample(rows, "doc_id", TREES * PER_TREE).select("ratios").toPandas()["ratios"].tolist()
    return IsolationForest(np.array(drawn, float)) if len(drawn) >= 4 else None


def fit_rules(docs: DataFrame, labels: DataFrame) -> tuple[IsolationForest | None, float]:
    """The forest and the score beyond which a document is anomalous (above 1: never).

    Every labelled document is scored by the forest of the half that it isn't in, and the threshold comes from counts of all
    these scores: by label and score in steps of 1 / STEPS."""
    rows = labelled_ratios(docs, labels)
    if rows.count() < 8 or rows.where("label = 1").isEmpty():
        return None, 2.0
    halves = [grown(rows.where(F.col("half") != k)) for k in (0, 1)]
    forest = grown(rows)
    halves = [h or forest for h in halves]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ratios, half = np.array(batch.column("ratios").to_pylist(), float), batch.column("half").to_numpy()
                scores, good = np.where(half == 0, halves[0].score(ratios), halves[1].score(ratios)), batch.column("label").to_numpy() == 1
                # a threshold mustn't lose good rows by the forest that judges in the end either
                scores[good] = np.maximum(scores[good], forest.score(ratios[good]))
                yield pa.RecordBatch.from_arrays([pa.array(good), pa.array(np.ceil(scores * STEPS).astype(np.int64))], ["good", "step"])

    counts = rows.select("label", "half", "ratios").mapInArrow(run, "good boolean, step long").groupBy("step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values("step")
    step, good, bad = (counts[c].to_numpy() for c in ("step", "good", "bad"))
    good_over, bad_over = good.sum() - np.cumsum(good), bad.sum() - np.cumsum(bad)
    # among the thresholds that lose few good rows, the one that parts the two labels best
    gain = bad_over / max(bad.sum(), 1) - good_over / good.sum()
    gain[good_over > GOOD_LOST * good.sum()] = -2.0
    return forest, float(step[int(np.argmax(gain))]) / STEPS


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, the COUNTS, anomaly score, base_failed and kept."""
    forest, threshold = fit_rules(docs, labels)

    def run(batches):
        for batch in pieces(batches):
            stats = np.array([text_stats(x) for x in column_bytes(batch, "text")]).reshape(batch.num_rows, len(COUNTS) + len(RATIOS))
            failed = base_failed(stats)
            score = forest.score(stats[:, RULES]) if forest else np.zeros(len(stats))
            counts = [pa.array(stats[:, i].astype(np.int64)) for i in range(len(COUNTS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(score), pa.array(failed), pa.array(~failed & (score <= threshold))], ["doc_id", *COUNTS, "anomaly", "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", anomaly double, base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
