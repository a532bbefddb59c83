"""Best-fit packing by hierarchical residual merging.

Texts become token ids and then pieces of at most `capacity` ids.  Every task packs its own pieces best-fit,
longest first, and emits the nearly full bins; the underfull ones go on as items, to fewer tasks each
round, until they fit one group of GROUP items or a round no longer lowers their number.

Nulls: a null text counts as empty and becomes the end id alone; a null id is kept.  Empty tables give empty
results.  Repeated rows are packed each for itself.  Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import column_bytes, in_use, pieces, small_batches, staged

CAPACITY = 2048
#: A bin with so few free places is emitted at once.
SLACK = 8
#: Words that a worker remembers.
CACHE = 700_000
#: Items that one task of a merging round gets, in the mean.
GROUP, FAN_IN = 40_000, 8

BIN = "sequence_id long, total long, members array<struct<doc_id long, piece int, start long, length long, ids_crc32 long, offset long>>"
_FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32", "offset")
_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


_MARKS = b".,;:!?*$%&#|()"
_LETTERS = regex.compile(r"[\p{Ll}\p{Lo}\p{Lu}]+")


def _letters(word: bytes) -> bool:
    """Whether a word is letters alone, and stays so when composed and lower-cased."""
    text = word.decode("utf-8", "replace")
    return _LETTERS.fullmatch(text) is not None and unicodedata.normalize("NFC", text).lower().isalpha()


class WordIds:
    """Token ids of texts by their words: white space parts tokens, so each word's ids can be remembered.

    Most words are letters with some marks behind them, which are two units to the tokenizer.  Such units are
    encoded many at once, in one text: each ends with the one token that has the end-of-word mark.
    """

    def __init__(self, path: str, mark: str = "</w>"):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith(mark)]] = True
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    def learn(self, texts: list[list[bytes]]) -> None:
        """Remembers the words of some texts."""
        in_use(self.known, CACHE)
        known, whole, parts, alone = self.known, [], [], []
        for w in set().union(*texts).difference(known):
            if w.isalpha():
                whole.append(w)
                continue
            core = w.rstrip(_MARKS)
            if core and (core.isalpha() or _letters(core)):
                parts.append((w, core, w[len(core) :]))
            else:
                alone.append(w)
        units = {u for _, *pair in parts for u in pair if u not in known}.difference(whole, (b"",))
        self._learn_units([*whole, *units])
        for w, core, tail in parts:
            known[w] = known[core] + known[tail] if tail else known[core]
        for w, e in zip(alone, self.encode([w.decode("utf-8", "replace") for w in alone], add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()

    def _learn_units(self, units: list[bytes], at_once: int = 4000) -> None:
        for i in range(0, len(units), at_once):
            some = units[i : i + at_once]
            (e,) = self.encode([b" ".join(some).decode()], add_special_tokens=False)
            ids = np.array(e.ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) == len(some):
                data = ids.tobytes()
                self.known.update((u, data[a:b]) for u, a, b in zip(some, [0, *stops], stops, strict=False))
            else:  # some unit isn't one to this tokenizer
                for u, one in zip(some, self.encode([u.decode() for u in some], add_special_tokens=False), strict=True):
                    self.known[u] = np.array(one.ids, "<u4").tobytes()

    def ids(self, words: list[bytes]) -> bytes:
        """Little-endian 32-bit ids, without the end id."""
        return b"".join(map(self.known.__getitem__, words))


_tokenizers: dict[str, WordIds] = {}


def tokenizer(path: str) -> WordIds:
    """One per worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that still takes it."""
    where = np.empty(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    levels, bins, sizes = 0, 0, lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        if fits := levels >> size:
            room = size + (fits & -fits).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                levels ^= 1 << room
        else:
            room, at, bins = capacity, bins, bins + 1
        where[i] = at
        if left := room - size:
            free[left].append(at)
            levels |= 1 << left
    return where


def packed(members: list[np.ndarray], counts: np.ndarray, capacity: int, number: int) -> pa.RecordBatch:
    """Items (their members' columns but the offset one after the other, counts of members by item) packed into bins."""
    item = np.repeat(np.arange(len(counts)), counts)
    sizes = np.bincount(item, members[3], minlength=len(counts)).astype(np.int64)
    bins = best_fit(sizes, capacity)
    order = np.argsort(bins[item], kind="stable")
    n = int(bins.max()) + 1 if len(bins) else 0
    ends = np.cumsum(np.bincount(bins[item], minlength=n))
    total = np.bincount(bins, sizes, minlength=n).astype(np.int64)
    length = members[3][order]
    offset = np.cumsum(length) - length - (np.cumsum(total) - total)[bins[item][order]]
    struct = pa.StructArray.from_arrays([pa.array(m, t, from_pandas=True) for m, t in zip([*(m[order] for m in members), offset], _TYPES, strict=True)], _FIELDS)
    task = TaskContext.get()
    first = (number << 56) + ((task.partitionId() if task else 0) << 28)
    return pa.RecordBatch.from_arrays([pa.array(first + np.arange(n)), pa.array(total), pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), struct)], ["sequence_id", "total", "members"])


def _nullable(column: pa.Array) -> np.ndarray:
    """Numbers; as objects where some are null."""
    return column.to_numpy(zero_copy_only=False) if not column.null_count else np.array(column.to_pylist(), object)


def token_bins(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Each task's texts as ids, cut into pieces and packed among themselves."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokens = tokenizer(path)
        rows: list[list] = [[] for _ in _FIELDS[:-1]]
        for batch in pieces(batches, 256):
            texts = [(x or b"").split() for x in column_bytes(batch, "text")]
            tokens.learn(texts)
            for key, words in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = tokens.ids(words) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (key, k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
        if rows[0]:
            keys = np.array(rows[0], object) if None in rows[0] else np.array(rows[0], np.int64)
            yield packed([keys, *(np.array(x, np.int64) for x in rows[1:])], np.ones(len(keys), np.int64), capacity, 0)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BIN)


def merged(bins: DataFrame, capacity: int, number: int) -> DataFrame:
    """Each task's bins packed as items."""

    def run(batches):
        got = [(b.column("members").flatten(), b.column("members").value_lengths().to_numpy()) for b in batches if b.num_rows]
        if got:
            members = pa.chunked_array([x for x, _ in got]).combine_chunks()
            members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
            yield packed([_nullable(c) for c in members.flatten()[:-1]], np.concatenate([n for _, n in got]).astype(np.int64), capacity, number)

    return bins.mapInArrow(run, BIN)


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, slack: int = SLACK, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and its offset there."""
    small_batches(docs.sparkSession)
    bins = staged(token_bins(docs, path, capacity, end_id))
    under = F.col("total") < capacity - slack
    done, number, parts = [bins.where(~under)], 0, bins.rdd.getNumPartitions()
    rest, left = bins.where(under), bins.where(under).count()
    while left > 1 and number < 100:
        groups = max(1, -(-left // group))
        parts, before, number = max(groups, min(parts, -(-left // 16)) // FAN_IN), left, number + 1
        bins = staged(merged(rest.repartition(max(parts, 1), F.xxhash64("sequence_id", F.lit(number))), capacity, number))
        last = parts <= 1
        done.append(bins.where(~under))
        rest = bins.where(under)
        left = 0 if last else rest.count()
        if last or parts <= groups and left > 0.98 * before:
            break
    done.append(rest)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")
