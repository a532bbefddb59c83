"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased and stripped of marks at both ends.  A mask over a run of words keeps the positions
marked 1 and ignores the others, so that a changed word in an ignored position doesn't lose the hit.  The hashes of
all masks over the test items are joined with those over every whole training text; around each hit the two
word sequences are laid along each other, and a passage counts if, of WINDOW words in a row (all words of a
shorter item), at least MATCHED agree.  The masks are chosen so that every such passage has a hit: LONG ones for items of
WINDOW words or more, MIDDLE ones for those from LEAST words on.  Shorter items count where all their words stand in a row,
and the whole item is the seed.

The corpus is read once, whatever the benchmark's size: a filter of the items' hashes, of bounded size, tells which of a text's
hashes can be in the benchmark, and only texts with such hashes go on to the join.

Nulls: null texts, empty ones and those without words match nothing; null ids are kept.  Empty tables give empty results.
Repeated training rows are each reported.  Of several items with one id, and of several places of an item in a text, the one with most
words that agree is reported, of equal ones the first.  Very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import column_bytes, in_use, mix, pieces, small_batches, staged

#: Kept (1) and ignored (0) positions, for items of at least WINDOW words, and for those of at least LEAST words.
LONG = ("11101011", "1101100111", "10110101101", "111000100111")
MIDDLE = ("110111", "11010011", "101001011")
LEAST, WINDOW, MATCHED = 8, 16, 0.8
#: All masks; those behind LONG and MIDDLE are whole items of 1 word, 2 words and so on.
MASKS = (*LONG, *MIDDLE, *("1" * n for n in range(1, LEAST)))
#: Bits of the filter for each hash of the benchmark, and its size at least and at most, as powers of two.
PER_HASH, FEWEST, MOST = 256, 16, 28
#: Hashes of the benchmark, words of its items and findings that are broadcast at most; parts of a common hash beyond it.
BROADCAST_SEEDS, BROADCAST_WORDS, BROADCAST_FOUND, SALTS = 500_000, 2_000_000, 1_000_000, 32
_ODD = mix(np.arange(1, 129, dtype=np.uint64)) | np.uint64(1)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


class _Plain(dict):
    """A word as it stands to the hash of its lower-cased core; 0 where it has none."""

    def __missing__(self, word: bytes) -> int:
        core = _EDGES.sub("", word.decode("utf-8", "replace").lower())
        self[word] = h = (xxhash.xxh3_64_intdigest(core) or 1) if core else 0
        return h


_plain = _Plain()


def word_ids(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a text's words with a core, and their positions among all its words."""
    words = data.split() if data else []
    in_use(_plain)
    found = np.fromiter(map(_plain.__getitem__, words), np.uint64, len(words))
    at = np.flatnonzero(found)
    return found[at], at


def masks_for(size: int) -> range:
    """The numbers of the masks that an item of so many words is searched by."""
    if size >= WINDOW:
        return range(len(LONG))
    if size >= LEAST:
        return range(len(LONG), len(LONG) + len(MIDDLE))
    first = len(LONG) + len(MIDDLE) + size - 1
    return range(first, first + (size > 0))


def seeds(words: np.ndarray, number: int) -> np.ndarray:
    """The hash of each place of a mask along the words."""
    kept = [i for i, c in enumerate(MASKS[number]) if c == "1"]
    m = len(words) - len(MASKS[number]) + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    total = np.full(m, _ODD[127 - number])
    for k, i in enumerate(kept):
        total += words[i : i + m] * _ODD[k + 16 * (number % 4)]
    return mix(total)


def matches(words: np.ndarray, own: np.ndarray, shifts: list[int]) -> tuple[int, int, int] | None:
    """The best place of an item's words along the shifts: words that agree, first and last place in the text (end exclusive)."""
    width = min(WINDOW, len(own))
    need = -(-4 * width // 5) if width >= LEAST else width
    best = None
    for shift in shifts:
        a, b = max(0, -shift), min(len(own), len(words) - shift)
        if b - a < width:
            continue
        sums = np.concatenate([[0], np.cumsum(own[a:b] == words[a + shift : b + shift])])
        full = np.flatnonzero(sums[width:] - sums[:-width] >= need)
        if len(full):
            first, last = int(full[0]), int(full[-1]) + width
            found = (int(sums[last] - sums[first]), -(a + first + shift), a + last + shift)
            best = found if best is None else max(best, found)
    return best and (best[0], -best[1], best[2])


class Filter:
    """Which hashes may be among the benchmark's: three bits for each."""

    def __init__(self, seeds_of: DataFrame, count: int):
        self.power = min(max((PER_HASH * count).bit_length(), FEWEST), MOST)

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(np.concatenate([*self._places(batch.column("hash").to_numpy().view(np.uint64))]))
                yield pa.RecordBatch.from_pydict({"data": [zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes(), 1)]}, pa.schema([("data", pa.binary())]))

        self.bits = np.zeros((1 << self.power) // 8, np.uint8)
        for row in seeds_of.select("hash").mapInArrow(bits, "data binary").toLocalIterator():
            at = np.cumsum(np.frombuffer(zlib.decompress(row["data"]), "<u4").astype(np.int64))
            np.bitwise_or.at(self.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        mask = np.uint64((1 << self.power) - 1)
        return (((hashes >> np.uint64(k)) & mask).astype(np.int64) for k in (0, 17, 35))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes that may be among the benchmark's."""
        left = np.arange(len(hashes))
        for k in range(3):
            (at,) = itertools.islice(self._places(hashes[left]), k, k + 1)
            left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
        return left


def _items(items: DataFrame) -> DataFrame:
    """item (a number for each id and text), item_id, words and seeds (hash, mask and place) of the test items."""
    seed = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = [word_ids(x)[0] for x in column_bytes(batch, "text")]
            lists = [[(h, i) for k in masks_for(len(w)) for i, h in enumerate(seeds(w, k).view(np.int64).tolist())] for w in own]
            masks = [list(masks_for(len(w))) for w in own]
            columns = [pa.array([w.tobytes() for w in own], pa.binary()), pa.array([[{"hash": h, "at": i} for h, i in x] for x in lists], seed), pa.array(masks, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), *columns], ["item", "item_id", "words", "seeds", "masks"])

    rows = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    keyed = rows.select(F.xxhash64(F.coalesce("item_id", F.lit(-1)), F.col("item_id").isNull(), "text").alias("item"), "item_id", "text")
    return keyed.mapInArrow(run, "item long, item_id long, words binary, seeds array<struct<hash long, at int>>, masks array<int>").where("size(seeds) > 0")


def _hits(docs: DataFrame, known: Filter, masks: list[int]) -> DataFrame:
    """doc_id, class of the text, its words, their positions and its hits (hash and place), for texts with hits.

    The words and hits of a class come once per task."""
    sent = docs.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("doc_id", pa.int64()), ("cid", pa.int64()), ("words", pa.binary()), ("places", pa.binary()), ("hits", pa.list_(pa.struct([("hash", pa.int64()), ("place", pa.int32())])))])

    def found_in(texts: list[np.ndarray]) -> list[list[dict]]:
        """The hits of each text; the words of all of them are laid end to end, and what reaches over an end is left out."""
        out: list[list[dict]] = [[] for _ in texts]
        ends = np.cumsum([len(x) for x in texts])
        words = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        for k in masks:
            grams = seeds(words, k)
            at = sent.value.may_hold(grams)
            owner = np.searchsorted(ends, at, "right")
            whole = at + len(MASKS[k]) <= ends[owner] if len(at) else np.zeros(0, bool)
            first = at - np.append(0, ends)[owner]
            for i, place, h in zip(owner[whole].tolist(), first[whole].tolist(), grams[at[whole]].view(np.int64).tolist(), strict=True):
                out[i].append({"hash": h, "place": place})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, bool] = {}
        for batch in pieces(batches):
            texts = column_bytes(batch, "text")
            classes = [xxhash.xxh3_64_intdigest(x) - (1 << 63) if x else None for x in texts]
            fresh = {c: x for c, x in zip(classes, texts, strict=True) if c is not None and c not in seen}
            parsed = {c: word_ids(x) for c, x in fresh.items()}
            hits = dict(zip(parsed, found_in([w for w, _ in parsed.values()]), strict=True))
            seen |= {c: bool(x) for c, x in hits.items()}
            out: list[tuple] = []
            for key, cid in zip(batch.column("doc_id").to_pylist(), classes, strict=True):
                if cid is not None and seen[cid]:
                    found = hits.pop(cid, None)
                    words, at = parsed[cid] if found else (None, None)
                    out.append((key, cid, words.tobytes(), at.astype(np.int32).tobytes(), found) if found else (key, cid, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, cid long, words binary, places binary, hits array<struct<hash long, place int>>")


def _verified(candidates: DataFrame) -> DataFrame:
    """cid, item_id, n_same, start, end and n_item of candidates (cid, item_id, words, places, own, shifts) that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            out: list[tuple] = []
            for x in batch.to_pylist():
                own, at = np.frombuffer(x["own"], np.uint64), np.frombuffer(x["places"], np.int32)
                found = matches(np.frombuffer(x["words"], np.uint64), own, x["shifts"])
                if found:
                    out.append((x["cid"], x["item_id"], found[0], int(at[found[1]]), int(at[found[2] - 1]) + 1, len(own)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(6)], ["cid", "item_id", "n_same", "start", "end", "n_item"])

    return candidates.mapInArrow(run, "cid long, item_id long, n_same long, start long, end long, n_item long")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per document and item found in it: doc_id, item_id, start, end (words of the text), n_same, n_item."""
    small_batches(docs.sparkSession)
    tests = staged(_items(items))
    count, size, used = tests.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0)), F.coalesce(F.sum(F.length("words") / 8), F.lit(0)), F.array_sort(F.array_distinct(F.flatten(F.collect_set("masks"))))).first()
    keys = tests.select(F.explode("seeds").alias("s"), "item").select("s.hash", "s.at", "item")
    rows = staged(_hits(docs, Filter(keys, count), used))
    texts = rows.where("words is not null").groupBy("cid").agg(F.first(F.struct("words", "places", "hits")).alias("t")).select("cid", "t.*")
    hits = rows.where("words is not null").select("cid", F.explode("hits").alias("h")).select("cid", "h.hash", "h.place")
    if count <= BROADCAST_SEEDS:
        met = hits.join(F.broadcast(keys), "hash")
    else:
        salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = hits.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"])
    shifts = met.groupBy("cid", "item").agg(F.collect_set((F.col("place") - F.col("at")).cast("long")).alias("shifts"))
    own = tests.select("item", "item_id", F.col("words").alias("own"))
    candidates = shifts.join(F.broadcast(own) if size <= BROADCAST_WORDS else own, "item").join(texts.drop("hits"), "cid")
    best = F.max(F.struct("n_same", (-F.col("start")).alias("__first"), "end", "n_item")).alias("best")
    found = staged(_verified(candidates).groupBy("cid", "item_id").agg(best).select("cid", "item_id", (-F.col("best.__first")).alias("start"), "best.end", "best.n_same", "best.n_item"))
    members = rows.select("doc_id", "cid")
    small = found.count() <= BROADCAST_FOUND
    return members.join(F.broadcast(found) if small else found, "cid").select("doc_id", "item_id", "start", "end", "n_same", "n_item")
