"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its subwords (runs of 3 and 4 bytes of the lower-cased
text that touch white space at their ends only), hashed into BUCKETS rows; a linear layer and a softmax
give the languages' probabilities.  Embeddings and layer are trained by stochastic gradient descent in
numpy on a bounded sample (SAMPLE documents); a temperature and a rejection threshold are set on a part
that the descent doesn't see: the threshold is the highest that is expected to lose RIGHT_LOST of right answers.

The descent runs in one task over the bounded sample; only the table of logits (BUCKETS rows, a column per language)
comes back to the driver.

Nulls: a null text, and one without letters, is `und` with score 0 and rejected.  Rows whose language or id is
null are not learned from; held_out is null for a null id.  Empty tables give empty results; with nothing to learn from
all rows are `und`.  Repeated rows are judged alike, each for itself; of several rows with one id the one with the least
hash of its text is learned from.  Ties: of equally likely languages the first in the alphabet.  Very long texts are read
whole, in batches of bounded bytes.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_sample, bucket, column_bytes, pieces, small_batches

SAMPLE, BUCKETS, WIDTH = 3000, 4096, 16
EPOCHS, BATCH, RATE = 12, 32, 0.2
#: Share of rightly labelled rows that the threshold is expected to reject at most (one in n + 1 where only n are held back).
RIGHT_LOST = 0.002
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def has_letter(data: bytes | None) -> bool:
    """Whether the text has a letter of any script (Unicode's categories L*)."""
    return bool(data) and (_ASCII_LETTER.search(data) is not None or any(map(str.isalpha, data.decode("utf-8", "replace"))))


def subwords(data: bytes) -> np.ndarray:
    """How often each bucket's subwords occur in the text."""
    x = _LOWER[np.frombuffer(b" " + data + b" ", np.uint8)].astype(np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    for n in (3, 4):
        m = len(x) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) ^ x[i : i + m]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        whole = x[1 : 1 + m] != 32
        for i in range(2, n - 1):
            whole &= x[i : i + m] != 32
        total += np.bincount((h[whole] >> np.uint32(11)) % np.uint32(BUCKETS), minlength=BUCKETS)
    return total


def averaged(counts: np.ndarray) -> np.ndarray:
    """Rows of counts as shares."""
    return (counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class LanguageModel:
    """langs, the table of each bucket's logits (embedding times layer, over the temperature), bias and threshold."""

    def __init__(self, langs: np.ndarray, table: np.ndarray, bias: np.ndarray, threshold: float):
        self.langs, self.table, self.bias, self.threshold = langs, table, bias, threshold

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(averaged(counts) @ self.table + self.bias)
        return self.langs[p.argmax(axis=1)], p.max(axis=1).astype(float)


def train(seen: list[np.ndarray], counts: list[np.ndarray], langs: np.ndarray, seed: int = 3) -> LanguageModel:
    """Learns from texts given as the buckets that they fill and how often; a batch at a time is spread out."""

    def shares(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), BUCKETS), np.float32)
        for i, row in enumerate(rows):
            x[i, seen[row]] = counts[row] / counts[row].sum()
        return x

    draw = np.random.default_rng(seed)
    names, y = np.unique(langs, return_inverse=True)
    k, order = len(names), draw.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    embed = draw.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, k), np.float32), np.zeros(k, np.float32)
    layer += draw.normal(0, 0.1, layer.shape).astype(np.float32)
    # each weight's step shrinks with the squared gradients that it has met, so that no rate makes the descent diverge
    parts = (embed, layer, bias)
    met = [np.full(w.shape, 1e-8, np.float32) for w in parts]
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in np.array_split(draw.permutation(used), max(1, len(used) // BATCH)):
            if not len(at):
                continue
            x = shares(at)
            hidden = x @ embed
            p = softmax(hidden @ layer + bias)
            p[np.arange(len(at)), y[at]] -= 1
            p /= len(at)
            for w, total, grad in zip(parts, met, (x.T @ (p @ layer.T), hidden.T @ p, p.sum(axis=0)), strict=True):
                total += grad * grad
                w -= rate * grad / np.sqrt(total)
    table = embed @ layer
    logits = np.concatenate([shares(part) @ table for part in np.array_split(held, -(-len(held) // BATCH))]) + bias if len(held) else np.zeros((0, k))
    grid = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0)
    loss = [-np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-9).mean() if len(held) else 0.0 for t in grid]
    heat, threshold = grid[int(np.argmin(loss))], 0.0
    if len(held):
        score, right = softmax(logits / heat).max(axis=1), logits.argmax(axis=1) == y[held]
        # the highest threshold within the loss allowed: one that only bounds the errors would reject nothing where the model makes few
        fine = np.sort(score[right])
        threshold = float(fine[max(int(RIGHT_LOST * (len(fine) + 1)), 1) - 1]) if len(fine) else 0.0
    return LanguageModel(names, (table / heat).astype(np.float32), (bias / heat).astype(np.float32), threshold)


def fit_languages(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel | None:
    """Learns from rows outside fold 2 of 4 that have a language; a bounded sample of their texts, in one task."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (bucket(F.col("doc_id"), 4) != 2))
    chosen = bounded_sample(rows.select("doc_id").distinct(), "doc_id", sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [subwords(x) if has_letter(x) else np.zeros(0, np.int64) for x in column_bytes(batch, "text")]
            seen = [np.flatnonzero(c) for c in found]
            lists = (pa.array(x, pa.list_(pa.int32())) for x in (seen, [c[s] for c, s in zip(found, seen, strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), batch.column("lang"), *lists], ["doc_id", "hash", "lang", "seen", "counts"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            got = batch.column("got")
            lists = [[np.asarray(x.values) for x in got.field(c)] for c in ("seen", "counts")]
            rows += zip(batch.column("doc_id").to_pylist(), got.field("lang").to_pylist(), *lists, strict=True)
        if not rows:
            return
        rows.sort(key=lambda x: x[0])
        model = train([x[2] for x in rows], [x[3] for x in rows], np.array([x[1] for x in rows], str))
        yield pa.RecordBatch.from_pydict({"langs": [model.langs.tolist()], "table": [model.table.tobytes()], "bias": [model.bias.tobytes()], "threshold": [model.threshold]})

    read = rows.join(F.broadcast(chosen), "doc_id", "left_semi").withColumn("hash", F.xxhash64("text"))
    counted = read.mapInArrow(count, "doc_id long, hash long, lang string, seen array<int>, counts array<int>").where("size(seen) > 0")
    once = counted.groupBy("doc_id").agg(F.min_by(F.struct("lang", "seen", "counts"), F.struct("hash", "lang")).alias("got"))
    got = once.repartition(1).mapInArrow(fit, "langs array<string>, table binary, bias binary, threshold double").first()
    if got is None:
        return None
    langs = np.array(got.langs, str)
    return LanguageModel(langs, np.frombuffer(got.table, np.float32).reshape(BUCKETS, len(langs)), np.frombuffer(got.bias, np.float32), got.threshold)


def language_id(docs: DataFrame, sample: int = SAMPLE, model: LanguageModel | None = None) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score and rejected (und, or a score under the threshold)."""
    model = model or fit_languages(docs, sample)

    def run(batches):
        for batch in pieces(batches):
            texts = column_bytes(batch, "text")
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            known = [i for i, x in enumerate(texts) if model is not None and has_letter(x)]
            if known:
                lang[known], score[known] = model.predict(np.array([subwords(texts[i]) for i in known]))
            rejected = (lang == "und") | (score < (model.threshold if model else 2.0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected.astype(bool))], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, sample: int = SAMPLE, model: LanguageModel | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose language isn't rejected."""
    model = model or fit_languages(docs, sample)

    def run(batches):
        for batch in pieces(batches):
            texts = column_bytes(batch, "text")
            keep = np.zeros(len(texts), bool)
            known = [i for i, x in enumerate(texts) if model is not None and has_letter(x)]
            if known:
                keep[known] = model.predict(np.array([subwords(texts[i]) for i in known]))[1] >= model.threshold
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
