"""N-gram Jaccard self-join by vertical partitioning.

A document is the set of the hashes of its n-word shingles.  Equal sets are one class from the start.  All
shingles stand in one global order, rarer ones first (by counts over the whole corpus in hash buckets, then by
hash).  Two sets that are similar enough share a shingle within the first places of their orders, so only those
prefixes are posted, and lengths and places discard pairs that can't reach the threshold.

The pairs left are counted by vertical partitioning: pivots cut the global order into FRAGMENTS of equal mass,
each set is cut into its segments, a task counts the overlap of the pairs' segments in one fragment only, and the
partial counts are summed per pair.

Postings of a common shingle aren't paired with each other at once.  First each is paired with the one whose
place is earliest, those links are joined to components, and then only postings of different components are paired, by
groups of equal length and place, as far as length and place still allow a link.  These groups meet by shingle, band of
lengths and salt, so that no shingle is one task's.  No pair between different components is left out, so the components
are those of all links.

Nulls: a null text, and one without words, has an empty set and is linked with nothing; a null id takes part and
never is the smallest.  Fewer words than n count as one shingle.  Empty tables give empty results.  Repeated rows
are of one class and each is returned.  Ties: shingles of equal counts are ordered by their hashes.  Very long texts are
read whole, and only the prefixes and segments of their sets are shuffled.  Other columns are ignored.  Shingles are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import BLOBS, HELD, PER_PARTITION, column_bytes, gathered, on_hot_keys, pieces, scattered, small_batches, staged, windows, word_hashes
from touchline.llm.components import components

#: Buckets of the corpus counts, a power of two; what tasks get of them is a byte for each.
BUCKETS, CHUNK = 1 << 22, 1 << 16
FRAGMENTS = 4
#: Postings of a shingle that are all paired with each other in one task.
RUN = 32
#: Pairs counted together in a task, and documents whose ids are broadcast at most.
CELL, BROADCAST_IDS = 2000, 1_000_000
#: Tasks' counts that are added up in one task, and tasks that the remaining groups of a shingle and band are spread over.
FAN_IN, SPREAD = 16, 8


def shingles(data: bytes | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles, A-Z lower-cased."""
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(word_hashes(words), min(n, len(words))))


def least_overlap(a, b, num: int, den: int):
    """The smallest intersection of sets of a and b shingles with den * intersection >= num * union."""
    return -(-num * (a + b) // (num + den))


def class_id(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _packed(counts: np.ndarray) -> bytes:
    """A chunk of counts by the steps between those over 0."""
    at = np.flatnonzero(counts)
    return zlib.compress(np.concatenate([np.diff(at, prepend=0), counts[at]]).astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    steps, found = np.split(np.frombuffer(zlib.decompress(data), "<u4"), 2)
    counts = np.zeros(CHUNK, np.uint32)
    counts[np.cumsum(steps)] = found
    return counts


def _first_pass(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and class of each document; and, with a null class, each task's bucket counts by chunk."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cid", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in pieces(batches):
            sizes, classes = [], []
            for data in column_bytes(batch, "text"):
                grams = shingles(data, n)
                sizes.append(len(grams))
                classes.append(class_id(grams) if len(grams) else None)
                np.add.at(counts, (grams & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if counts.any():
            rows = [(None, None, None, i, _packed(counts[i * CHUNK : (i + 1) * CHUNK])) for i in range(BUCKETS // CHUNK)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, cid long, chunk int, counts binary")


def _summed(counts: DataFrame, by: int) -> DataFrame:
    """chunk, part, counts added up within by parts of each chunk, one batch after the other."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                add = _unpacked(data)
                total[chunk] = np.minimum(total[chunk].astype(np.uint64) + add, 2**32 - 1).astype(np.uint32) if chunk in total else add
        yield pa.RecordBatch.from_pydict({"chunk": list(total), "counts": [_packed(x) for x in total.values()]}, pa.schema([("chunk", pa.int32()), ("counts", pa.binary())]))

    part = F.pmod(F.xxhash64("counts"), F.lit(by))
    return counts.repartition(BUCKETS // CHUNK // 4 * by, "chunk", part).mapInArrow(run, "chunk int, counts binary")


class Order:
    """The global order: a level for each bucket, pivots between fragments, and the level from which a shingle is common."""

    def __init__(self, counts: DataFrame, total: int):
        levels = np.zeros(BUCKETS, np.uint8)
        mass = np.zeros(256)
        counts, parts = counts.select("chunk", "counts"), counts.rdd.getNumPartitions()
        while parts > 1:
            parts = -(-parts // FAN_IN)
            counts = _summed(counts, parts)
        for row in counts.toLocalIterator():
            x = _unpacked(row["counts"])
            at = (4 * np.log2(x + 1.0)).astype(np.uint8)
            levels[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = at
            mass += np.bincount(at, x, 256)
        self.levels = levels
        self.common = int(4 * np.log2(8 * total / BUCKETS + 1000))
        ends = np.cumsum(mass) / max(mass.sum(), 1)
        goal = np.arange(1, FRAGMENTS) / FRAGMENTS
        level = np.minimum(np.searchsorted(ends, goal), 255)
        inside = (goal - np.where(level > 0, ends[level - 1], 0)) / np.maximum(np.diff(ends, prepend=0)[level], 1e-12)
        self.pivots = (level.astype(np.uint64) << np.uint64(56)) + (np.clip(inside, 0, 1) * (2.0**56 - 2**8)).astype(np.uint64)

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Places in the global order."""
        return (self.levels[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (grams >> np.uint64(8))

    def common_ones(self, grams: np.ndarray) -> np.ndarray:
        """Which shingles are common."""
        return self.levels[(grams & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int64) > self.common


#: A shingle in the prefix of a class's set of n, and its place there.
POSTING = np.dtype([("gram", "<i8"), ("cid", "<i8"), ("n", "<i4"), ("place", "<i4")])


def _postings(docs: DataFrame, n: int, num: int, den: int, order, buckets: int) -> DataFrame:
    """The prefix of each set, a class once per task: rarer shingles by shingle (kind 0), common ones by class (kind 1)."""

    def run(batches):
        known, seen = order.value, set()
        held: list[np.ndarray] = []
        size = 0

        def flush():
            rows = np.concatenate(held)
            common = known.common_ones(rows["gram"].view(np.uint64))
            for kind, part, key in ((0, rows[~common], "gram"), (1, rows[common], "cid")):
                if len(part):
                    yield scattered(part, part[key].copy(), buckets, kind)

        for batch in pieces(batches):
            for data in column_bytes(batch, "text"):
                grams = shingles(data, n)
                size_of = len(grams)
                if not size_of or (cid := class_id(grams)) in seen:
                    continue
                seen.add(cid)
                keys = known.keys(grams)
                places = size_of + (-num * size_of // den) + 1
                first = np.argpartition(keys, places - 1)[:places] if places < size_of else np.arange(size_of)
                found = np.empty(places, POSTING)
                found["gram"], found["cid"], found["n"], found["place"] = grams[first[np.argsort(keys[first])]].view(np.int64), cid, size_of, np.arange(places)
                held.append(found)
                size += places
            if size > HELD:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return docs.select("text").mapInArrow(run, BLOBS)


def _may_link(a: str, b: str, num: int, den: int) -> F.Column:
    """Whether lengths and places of two postings of a shingle still allow a link."""
    la, lb = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    room = F.least(la - F.col(f"{a}.place"), lb - F.col(f"{b}.place"))
    return (F.least(la, lb) * den >= F.greatest(la, lb) * num) & (room * (num + den) >= (la + lb) * num)


def _runs(postings: DataFrame, parts: int, num: int, den: int) -> DataFrame:
    """Postings of rarer shingles, brought together: pairs of classes.  Of common shingles, which are spread by class, and of
    runs over RUN the postings themselves come out, with b null."""
    schema = "gram long, a long, b long, na int, nb int, place int"

    def run(batches):
        got = gathered(batches, {0: POSTING, 1: POSTING})
        common = got[1]
        if len(common):
            none = pa.nulls(len(common))
            columns = {c: np.ascontiguousarray(common[c]) for c in POSTING.names}
            yield pa.RecordBatch.from_arrays([pa.array(columns["gram"]), pa.array(columns["cid"]), none.cast(pa.int64()), pa.array(columns["n"]), none.cast(pa.int32()), pa.array(columns["place"])], ["gram", "a", "b", "na", "nb", "place"])
        if not len(got[0]):
            return
        gram, cid, n, place = (np.ascontiguousarray(got[0][c]) for c in POSTING.names)
        order = np.lexsort((cid, gram))
        gram, cid, n, place = gram[order], cid[order], n[order].astype(np.int64), place[order].astype(np.int64)
        once = np.r_[True, (gram[1:] != gram[:-1]) | (cid[1:] != cid[:-1])]
        gram, cid, n, place = gram[once], cid[once], n[once], place[once]
        starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
        size = np.repeat(np.diff(np.r_[starts, len(gram)]), np.diff(np.r_[starts, len(gram)]))
        long = size > RUN
        none = pa.nulls(int(long.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(gram[long]), pa.array(cid[long]), none.cast(pa.int64()), pa.array(n[long].astype(np.int32)), none.cast(pa.int32()), pa.array(place[long].astype(np.int32))], ["gram", "a", "b", "na", "nb", "place"])
        short = (size > 1) & ~long
        gram, cid, n, place = gram[short], cid[short], n[short], place[short]
        found = []
        for d in range(1, RUN):
            x = np.flatnonzero(gram[d:] == gram[:-d])
            y = x + d
            room = np.minimum(n[x] - place[x], n[y] - place[y])
            ok = (np.minimum(n[x], n[y]) * den >= np.maximum(n[x], n[y]) * num) & (room * (num + den) >= (n[x] + n[y]) * num)
            found.append(np.stack([cid[x[ok]], cid[y[ok]], n[x[ok]], n[y[ok]]], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        none = pa.nulls(len(pairs))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2].astype(np.int32)), pa.array(pairs[:, 3].astype(np.int32)), none.cast(pa.int32())], ["gram", "a", "b", "na", "nb", "place"])

    return postings.repartition(parts, "bucket").mapInArrow(run, schema)


def _pairs(rows: DataFrame) -> DataFrame:
    """a, b (a < b), na, nb and whether a is the hub, each pair once."""
    swap = F.col("a") > F.col("b")
    rows = rows.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"), F.when(swap, ~F.col("hub")).otherwise(F.col("hub")).alias("hub"))
    return rows.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.max("hub").alias("hub"))


def _overlaps(segments, pairs) -> pa.Table:
    """The overlap of each pair's segments in one fragment."""
    held = {c: np.frombuffer(s, np.uint64) for c, s in zip(segments.column("cid").to_pylist(), segments.column("segment").to_pylist(), strict=True)}
    none = np.empty(0, np.uint64)
    a, b = pairs.column("a").to_pylist(), pairs.column("b").to_pylist()
    same = [len(np.intersect1d(held.get(x, none), held.get(y, none), assume_unique=True)) for x, y in zip(a, b, strict=True)]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "same": pa.array(same, pa.int64())})


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int, num: int, den: int, order) -> DataFrame:
    """Those of the pairs that link: segments meet in their fragments, partial overlaps are summed per pair."""
    count = pairs.count()
    if not count:
        return pairs.select("a", "b")
    cells = max(1, -(-count // CELL))
    dealt = pairs.withColumn("cell", F.pmod(F.xxhash64(F.when(F.col("hub"), F.col("b")).otherwise(F.col("a"))), F.lit(cells)).cast("int"))
    needs = dealt.select(F.col("a").alias("cid"), F.col("cell").alias("to")).unionByName(dealt.select(F.col("b").alias("cid"), F.col("cell").alias("to"))).distinct()
    wanted = staged(needs.select("cid").distinct().join(classes, "cid").select("cid", F.col("doc_id").alias("rep")))
    small = wanted.count() <= BROADCAST_IDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted) if small else wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("cid", "text")

    def cut(batches):
        known = order.value
        for batch in pieces(batches):
            out: list[tuple] = []
            for cid, data in zip(batch.column("cid").to_pylist(), column_bytes(batch, "text"), strict=True):
                grams = shingles(data, n)
                if class_id(grams) == cid:
                    part = np.searchsorted(known.pivots, known.keys(grams), "right")
                    out.append((cid, [grams[part == f].tobytes() for f in range(FRAGMENTS)]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.binary()))], ["cid", "segments"])

    segments = rows.mapInArrow(cut, "cid long, segments array<binary>").join(needs, "cid").select("cid", "to", F.posexplode("segments").alias("part", "segment"))
    asked = dealt.select("a", "b", "cell", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    partial = segments.groupBy("to", "part").cogroup(asked.groupBy("cell", "fragment")).applyInArrow(_overlaps, "a long, b long, same long")
    total = partial.groupBy("a", "b").agg(F.sum("same").alias("same")).join(pairs, ["a", "b"])
    return staged(total.where(F.col("same") * den >= (F.col("na").cast("long") + F.col("nb") - F.col("same")) * num).select("a", "b"))


def ngram_join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id.

    Two documents link when den * intersection >= num * union; component_id is the smallest doc_id that
    links reach, itself included.
    """
    spark = docs.sparkSession
    small_batches(spark)
    first = staged(_first_pass(docs, n))
    sets = first.where("chunk is null").select("doc_id", "n_shingles", "cid")
    classes = staged(sets.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")))
    sums = (F.sum("n"), F.sum(F.col("n") * (den - num) / den + 1), F.sum("copies"))
    total, posted, rows = classes.agg(*(F.coalesce(x, F.lit(0)) for x in sums)).first()
    order = spark.sparkContext.broadcast(Order(first.where("chunk is not null"), int(total)))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(posted) // 1_000_000))
    runs = staged(_runs(_postings(docs, n, num, den, order, PER_PARTITION * parts), parts, num, den))
    common = staged(runs.where("b is null").select("gram", F.col("a").alias("cid"), F.col("na").alias("n"), "place").distinct())
    hubs = common.groupBy("gram").agg(F.min(F.struct("place", "cid", "n")).alias("h"), F.count(F.lit(1)).alias("__n"))
    hubs = hubs.select("gram", F.col("h.place").alias("hub_place"), F.col("h.cid").alias("hub_cid"), F.col("h.n").alias("hub_n"), "__n")
    met = on_hot_keys(common, hubs, "gram", common.count())
    y = F.struct(F.col("hub_n").alias("n"), F.col("hub_place").alias("place"))
    star = met.withColumns({"x": F.struct("n", "place"), "y": y}).where(_may_link("x", "y", num, den))
    star = star.select(F.col("hub_cid").alias("a"), F.col("cid").alias("b"), F.col("hub_n").alias("na"), F.col("n").alias("nb"), F.lit(True).alias("hub"))
    short = runs.where("b is not null").select("a", "b", "na", "nb", F.lit(True).alias("hub"))
    pairs = staged(_pairs(short.unionByName(star)))
    links = _links(docs, classes, pairs, n, num, den, order)
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    extra = _links(docs, classes, staged(_between(common, roots, num, den).join(pairs, ["a", "b"], "left_anti")), n, num, den, order)
    if extra.limit(1).count():
        edges = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(extra.select(F.col("a").alias("u"), F.col("b").alias("v")))
        roots = components(edges)
    return _labelled(sets, classes, roots, int(rows))


def _between(common: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that are left of the common shingles: postings of different components whose lengths and places allow a link."""
    rooted = common.join(roots, common["cid"] == roots["node"], "left")
    owned = staged(rooted.select("gram", "cid", "n", "place", F.coalesce("root", "cid").alias("root")))
    mixed = owned.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("__n")).where("lo < hi")
    owned = on_hot_keys(owned, mixed.select("gram", "__n"), "gram", owned.count())
    groups = staged(owned.select("gram", "root", "n", "place").distinct())
    # lengths of linked sets differ by one band at most
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int") if den > num else F.lit(0)
    names = ("root", "n", "place")
    x = groups.select("gram", band.alias("band"), F.pmod(F.xxhash64(*names), F.lit(SPREAD)).cast("int").alias("salt"), F.struct(*names).alias("x"))
    y = groups.select("gram", F.explode(F.array(band - 1, band, band + 1)).alias("band"), F.struct(*names).alias("y"))
    y = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    met = x.join(y, ["gram", "band", "salt"]).where((F.col("x.root") < F.col("y.root")) & _may_link("x", "y", num, den)).select("gram", "x", "y")
    for side, name in (("x", "a"), ("y", "b")):
        members = owned.select("gram", F.struct(*names).alias(side), F.col("cid").alias(name))
        met = met.join(members, ["gram", side])
    return _pairs(met.select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"), F.lit(False).alias("hub")))


def _labelled(sets: DataFrame, classes: DataFrame, roots: DataFrame, rows: int) -> DataFrame:
    """Each document with the smallest id of its component."""
    owned = classes.join(roots, classes["cid"] == roots["node"], "left").select("cid", "doc_id", "copies", F.coalesce("root", "cid").alias("root"))
    least = owned.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    table = staged(on_hot_keys(owned, least, "root", rows).select("cid", "component_id", F.col("copies").alias("__n")))
    return on_hot_keys(sets, table, "cid", rows, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s FROM w),
s AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
l AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id
FROM g LEFT JOIN (SELECT u, min(v) AS c FROM r GROUP BY u) m ON doc_id = u
"""
