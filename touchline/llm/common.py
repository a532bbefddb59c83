"""Helpers that several corpus operators share: scratch space, word hashes, bounded samples."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that a Python worker remembers; the cache is emptied beyond it.
CACHE_WORDS = 200_000
#: Bytes of an Arrow batch at most: texts are long, and several batches are held at once.
BATCH_BYTES = 8 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, an own one in local mode, an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="touchline-"))
        path = context._jsc.sc().getCheckpointDir().get()
    return path.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches small enough for executors with little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_in_use: list[dict] = []


def in_use(cache: dict, most: int = CACHE_WORDS) -> None:
    """Call before a worker fills a cache: it is emptied if it has grown large, and so is another one that was used before."""
    if _in_use and _in_use[0] is not cache:
        _in_use[0].clear()
    _in_use[:] = [cache]
    if len(cache) > most:
        cache.clear()


class _Words(dict):
    """Word (bytes) to its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The 64-bit hash of each word."""
    in_use(_words)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words, in order; none if there are fewer words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for i in range(n):
        total += mix(hashes[i : i + m] + _ODD[i]) * _ODD[i]
    return mix(total)


#: Many small records travel as one binary row per bucket: bucket, a kind of record, and the records side by side.
BLOBS = "bucket int, kind int, data binary"
_BLOBS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])
#: Buckets for each partition that they are dealt to, and records that a task holds before it sends them.
PER_PARTITION, HELD = 4, 400_000


def scattered(records: np.ndarray, key: np.ndarray, buckets: int, kind: int = 0) -> pa.RecordBatch:
    """Records (a structured array) as rows of BLOBS by a hash of their 64-bit key."""
    bucket = (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    records, edges = records[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(edges))
    data = [records[edges[b] : edges[b + 1]].tobytes() for b in used.tolist()]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), kind), pa.int32()), pa.array(data, pa.binary())], schema=_BLOBS)


def gathered(batches: Iterator[pa.RecordBatch], kinds: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    """The records of each kind that rows of BLOBS hold."""
    parts: dict[int, list[bytes]] = {k: [] for k in kinds}
    for batch in batches:
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True):
            parts[kind].append(data)
    return {k: np.frombuffer(b"".join(parts.pop(k)), t) for k, t in kinds.items()}


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes."""
    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], size: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most size rows, to bound memory."""
    for batch in batches:
        for i in range(0, batch.num_rows, size):
            yield batch.slice(i, size)


def bucket(column: F.Column, n: int) -> F.Column:
    """crc32 of a key as text, modulo n: the folds of the contracts."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(n)


def bounded_sample(keys: DataFrame, column: str, most: int) -> DataFrame:
    """At most that many rows of keys, the same ones on every run, chosen by a hash of column."""
    return keys.orderBy(F.xxhash64(F.col(column), F.lit(17)), F.col(column)).limit(most)


#: Ids that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: A key is hot if it has over so many rows, and over a HOT_PARTS-th of all: HOT_PARTS keys at most are hot.
HOT_ROWS, HOT_PARTS = 1_000, 10_000


def on_hot_keys(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows (total of them) joined with a table that has a row per key, and in __n how many of the rows are of that key.

    Hot keys, which are few, come from a broadcast, so that none of them gathers its rows in one task; the others meet by shuffle."""
    names = [c for c in table.columns if c not in (key, "__n")]
    hot = table.where(F.col("__n") > max(HOT_ROWS, total // HOT_PARTS)).select(key, F.struct(F.lit(1).alias("__is"), *names).alias("__hot"))
    marked = rows.join(F.broadcast(hot), key, "left")
    rest = marked.where("__hot is null").select(rows.columns).join(table.drop("__n"), key, how).select(*rows.columns, *names)
    return rest.unionByName(marked.where("__hot is not null").select(*rows.columns, *(F.col(f"__hot.{c}").alias(c) for c in names)))


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of docs whose id isn't among ids; rows with a null id stay."""
    ids = staged(ids.select(F.col(column).alias("__gone")).where(F.col("__gone").isNotNull()).distinct())
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, docs[column] == ids["__gone"], "left_anti")
