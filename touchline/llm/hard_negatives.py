"""Hard-negative mining by one-dimensional distance keys.

Vectors are whole numbers, floor(scale * x).  With M, the greatest squared length, each gets one more coordinate, the root of what
its squared length lacks to M, and a query gets 0 there: squared distances are then |q|^2 + M - 2 * score, so nearest means highest
inner product.  Each vector belongs to its nearest pivot, and its key is (pivot, distance).  Vectors are stored sorted by key, in
blocks of at most BLOCK rows that lie within one ring of one pivot, as a Parquet table in the shared folder.

A query scans key intervals around its own distance to each pivot, nearest ring first.  By the triangle inequality nothing in a ring is
nearer than the ring's gap in distance, so when the k-th best score found exceeds what the nearest unscanned ring could hold, the
result is certified and the query leaves; the others go on with the next, larger share of rows (SHARES, at last all).  Rings out of
reach of the scores that are asked for are never scanned.  Results are exact; pivots and rings, which come from a sample
of SAMPLE rows, only decide how much is scanned.

Scale: the directory of rings has PIVOTS * RINGS rows however many vectors there are.  Queries travel, in packets of PACKET, to groups of
blocks (ring and salt, about GROUP rows each), so a ring that holds a third of all rows, copies of one vector say, is many groups, and
a join meets a packet with a block at a time.  Tasks keep only the k best of a request and merge them by shuffle.

Nulls: rows with a null id, label or vector, or a null or non-finite component take no part.  Shorter vectors count as padded with
zeros.  Ties go to the smaller id.  Rows that repeat an id are rows of their own as positives and negatives; an anchor is taken once, with
the smallest label and vector, and rows with its id aren't its positives.  Very long vectors are whole; if a score could leave the range of 64-bit
integers, an error is raised.  Empty tables, and anchors without positives, give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import bounded_sample, shared_dir, staged

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: Shares of all rows that are scanned for a query before the next certification.
SHARES = (1 / 16, 1 / 4, 1.0)
SAMPLE, PIVOTS, RINGS, ROUNDS = 4096, 16, 16, 8
#: Rows of a block, of a group of blocks, and requests of a packet; candidates that a task holds before it keeps the best of them.
BLOCK, GROUP, PACKET, HELD = 512, 1 << 16, 256, 400_000
_LEAST, _MOST = -(1 << 62), 1 << 62
_ROW = "vec_id long, label long, data binary"


def eligible(rows: DataFrame, relabel: Column | None = None) -> DataFrame:
    """vec_id, label and embedding of rows that take part; relabel says which labels move on by one (modulo 10)."""
    label = F.col("label").cast("long")
    label = label if relabel is None else F.when(relabel, (label + 1) % 10).otherwise(label)
    kept = rows.where("vec_id is not null and label is not null and embedding is not null")
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))


def _vectors(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows of a batch whose components are all finite, and their whole-number vectors."""
    column = batch.column("embedding")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    edges = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.flatnonzero(bad[edges[1:]] == bad[edges[:-1]])
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(scale * flat)
    return good, [whole[edges[i] : edges[i + 1]] for i in good.tolist()]


def packed(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and data, the whole-number vector as 32-bit numbers."""

    def run(batches):
        for batch in batches:
            good, vectors = _vectors(batch, scale)
            if any(len(v) and np.abs(v).max() > 2**31 - 1 for v in vectors):
                raise ValueError("components are too large for exact scores")
            data = pa.array([v.astype(np.int32).tobytes() for v in vectors], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(good)), batch.column("label").take(pa.array(good)), data], ["vec_id", "label", "data"])

    return rows.mapInArrow(run, _ROW)


def _matrix(data: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros to the width."""
    if all(len(x) == 4 * width for x in data):
        return np.frombuffer(b"".join(data), np.int32).reshape(len(data), width)
    out = np.zeros((len(data), width), np.int32)
    for row, x in zip(out, data, strict=True):
        row[: len(x) // 4] = np.frombuffer(x, np.int32)
    return out


def _bounds(rows: DataFrame) -> tuple[int, int, int, float]:
    """Number of rows, greatest width, component and squared length."""

    def run(batches):
        n, width, most, square = 0, 0, 0, 0.0
        for batch in batches:
            for x in batch.column("data").to_pylist():
                v = np.frombuffer(x, np.int32).astype(np.float64)
                n, width = n + 1, max(width, len(v))
                most, square = max(most, int(np.abs(v).max(initial=0))), max(square, float(v @ v))
        yield pa.RecordBatch.from_pydict({"n": [n], "width": [width], "most": [most], "square": [square]})

    found = rows.select("data").mapInArrow(run, "n long, width long, most long, square double").agg(F.sum("n"), F.max("width"), F.max("most"), F.max("square")).first()
    return tuple(x or 0 for x in found)


class Keys:
    """Pivots, rings and the directory; all of bounded size, whatever the number of vectors."""

    def __init__(self, sample: np.ndarray, width: int, most: int, square: float, seed: int = 1):
        self.width, self.square, self.exact = width, square, width * most * most < 2**53
        if width * most * most >= 2**62:
            raise ValueError("components are too large for exact scores")
        x, rng = self.raised(sample), np.random.default_rng(seed)
        self.pivots = x[rng.permutation(len(x))[:PIVOTS]]
        for _ in range(ROUNDS):
            near = self.distances(x).argmin(axis=1)
            self.pivots = np.stack([x[near == k].mean(axis=0) if (near == k).any() else p for k, p in enumerate(self.pivots)])
        far = self.distances(x)
        near = far.argmin(axis=1)
        steps = np.linspace(0, 1, RINGS + 1)[1:-1]
        self.edges = [np.quantile(far[near == k, k], steps) if (near == k).any() else np.zeros(len(steps)) for k in range(len(self.pivots))]
        self.low = self.high = self.size = self.salts = np.empty(0)

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Vectors with their additional coordinate."""
        x = x.astype(np.float64)
        return np.column_stack([x, np.sqrt(np.maximum(self.square - np.einsum("ij,ij->i", x, x), 0.0))])

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To each pivot, of vectors that have the additional coordinate."""
        p = self.pivots
        return np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", p, p) - 2 * x @ p.T, 0.0))

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pivot, distance and ring of stored vectors."""
        far = self.distances(self.raised(x))
        pivot = far.argmin(axis=1)
        distance = far[np.arange(len(x)), pivot]
        return pivot, distance, np.array([np.searchsorted(self.edges[p], d) for p, d in zip(pivot.tolist(), distance.tolist(), strict=True)], np.int64)

    def directed(self, directory: list) -> Keys:
        """With the directory: per ring the least and greatest distance, rows, and salts."""
        cells = PIVOTS * RINGS
        self.low, self.high, self.size = np.full(cells, np.inf), np.full(cells, -np.inf), np.zeros(cells)
        for cell, low, high, n in directory:
            self.low[cell], self.high[cell], self.size[cell] = low, high, n
        self.salts = np.maximum(np.ceil(self.size / GROUP), 1).astype(np.int64)
        return self

    def plan(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query the rings in the order of scanning, the highest score that each can hold (in that order), and the lowest (likewise).

        The slack is far above rounding; too high a bound only scans more."""
        q = q.astype(np.float64)
        square = np.einsum("ij,ij->i", q, q)
        far = np.repeat(self.distances(np.column_stack([q, np.zeros(len(q))])), RINGS, axis=1)
        far = np.pad(far, ((0, 0), (0, PIVOTS * RINGS - far.shape[1])))
        gap = np.where(self.size > 0, np.maximum(np.maximum(self.low - far, far - self.high), 0.0), np.inf)
        order = np.argsort(gap, axis=1, kind="stable")
        whole = (square + self.square)[:, None]
        slack = 1e-9 * whole + 1.0
        best = (whole - np.take_along_axis(gap, order, 1) ** 2) / 2 + slack
        worst = (whole - np.take_along_axis(np.where(self.size > 0, far + self.high, 0.0), order, 1) ** 2) / 2 - slack
        return order, best, worst

    def reach(self, order: np.ndarray, share: float) -> np.ndarray:
        """How many rings of the order are scanned when at least that share of all rows is."""
        done = np.cumsum(self.size[order], axis=1)
        return np.minimum((done < share * self.size.sum()).sum(axis=1) + 1, (self.size > 0).sum())


#: A request: the anchor, a slot (which tells requests of an anchor apart), its label, and the lowest and highest score that counts.
_REQUEST = [("anchor_id", np.int64), ("slot", np.int64), ("label", np.int64), ("low", np.int64), ("high", np.int64)]
REQUESTS = "anchor_id long, slot long, label long, low long, high long, data binary"
FOUND = "anchor_id long, slot long, score long, vec_id long"


def stored(rows: DataFrame, keys: Keys, folder: str) -> DataFrame:
    """Blocks of vectors in order of (pivot, distance), written to the folder; fills in the directory of keys."""

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                pivot, distance, ring = keys.of(_matrix(batch.column("data").to_pylist(), keys.width))
                yield pa.RecordBatch.from_arrays([pa.array(pivot * RINGS + ring, pa.int32()), pa.array(distance), *(batch.column(c) for c in ("vec_id", "label", "data"))], ["cell", "distance", "vec_id", "label", "data"])

    def blocks(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            starts = np.flatnonzero(np.diff(cell, prepend=-1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                for i in range(a, b, BLOCK):
                    part = batch.slice(i, min(BLOCK, b - i))
                    at, ids = part.column("distance").to_numpy(), part.column("vec_id").to_numpy()
                    x = _matrix(part.column("data").to_pylist(), keys.width)
                    yield pa.RecordBatch.from_pydict({"cell": pa.array([cell[a]], pa.int32()), "low": [at.min()], "high": [at.max()], "n": pa.array([len(ids)], pa.int64()), "first": pa.array(ids[:1]), "ids": [ids.tobytes()], "labels": [part.column("label").to_numpy().tobytes()], "vectors": [x.tobytes()]})

    table = rows.mapInArrow(keyed, "cell int, distance double, " + _ROW).repartitionByRange("cell", "distance", "vec_id").sortWithinPartitions("cell", "distance", "vec_id")
    table.mapInArrow(blocks, "cell int, low double, high double, n long, first long, ids binary, labels binary, vectors binary").write.parquet(folder)
    table = rows.sparkSession.read.parquet(folder)
    keys.directed(table.groupBy("cell").agg(F.min("low"), F.max("high"), F.sum("n")).collect())  # PIVOTS * RINGS rows at most
    salts = F.element_at(F.lit([int(x) for x in keys.salts]), F.col("cell") + 1)
    return table.withColumn("salt", F.pmod(F.xxhash64("first", "low"), salts).cast("int"))


def _requests(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    heads = np.zeros(batch.num_rows, _REQUEST)
    for name, _ in _REQUEST:
        heads[name] = batch.column(name).to_numpy()
    return heads, _matrix(batch.column("data").to_pylist(), width)


def _packets(requests: DataFrame, keys: Keys, done: float, share: float) -> DataFrame:
    """Packets of requests for each ring and salt that they scan in this round."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            heads, q = _requests(batch, keys.width)
            order, best, worst = keys.plan(q)
            place = np.arange(order.shape[1])
            now = place < keys.reach(order, share)[:, None]
            if done:
                now &= place >= keys.reach(order, done)[:, None]
            now &= (best >= heads["low"][:, None]) & (worst <= heads["high"][:, None])
            row, at = np.nonzero(now)
            cell = order[row, at]
            by = np.argsort(cell, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(cell[by])) + 1):
                for i in range(0, len(part), PACKET):
                    some, c = row[part[i : i + PACKET]], int(cell[part[0]]) if len(part) else 0
                    if len(some):
                        salts = int(keys.salts[c])
                        yield pa.RecordBatch.from_pydict({"cell": pa.array([c] * salts, pa.int32()), "salt": pa.array(range(salts), pa.int32()), "heads": [heads[some].tobytes()] * salts, "queries": [q[some].tobytes()] * salts})

    return requests.mapInArrow(run, "cell int, salt int, heads binary, queries binary")


def kept(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best candidates of each request: highest score, then smallest id."""
    order = np.lexsort((ids, -score, slot, anchor))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(anchor[order]) != 0) | (np.diff(slot[order]) != 0)
    starts = np.flatnonzero(fresh)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def candidates(heads: np.ndarray, q: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, same: bool, k: int, exact: bool) -> tuple[np.ndarray, ...]:
    """anchor, slot, score and id of a superset of each request's k best rows of a block; ties with the k-th are all kept."""
    scores = (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if exact else q.astype(np.int64) @ x.astype(np.int64).T
    fit = (labels == heads["label"][:, None]) & (ids != heads["anchor_id"][:, None]) if same else labels != heads["label"][:, None]
    fit &= (scores >= heads["low"][:, None]) & (scores <= heads["high"][:, None])
    scores = np.where(fit, scores, _LEAST - 1)
    if scores.shape[1] > k:
        fit &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
    row, at = np.nonzero(fit)
    return heads["anchor_id"][row], heads["slot"][row], scores[row, at], ids[at]


def _scan(packets: DataFrame, table: DataFrame, keys: Keys, same: bool, k: int) -> DataFrame:
    """The k best rows of each request in what each task sees."""

    def run(batches: Iterator[pa.RecordBatch]):
        parts, n = [], 0

        def best():
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            at = kept(*columns, k)
            return [c[at] for c in columns]

        for batch in batches:
            for heads, q, ids, labels, x in zip(*(batch.column(c).to_pylist() for c in ("heads", "queries", "ids", "labels", "vectors")), strict=True):
                heads, ids = np.frombuffer(heads, _REQUEST), np.frombuffer(ids, np.int64)
                parts.append(candidates(heads, np.frombuffer(q, np.int32).reshape(len(heads), -1), ids, np.frombuffer(labels, np.int64), np.frombuffer(x, np.int32).reshape(len(ids), -1), same, k, keys.exact))
                n += len(parts[-1][0])
                if n > HELD:
                    parts = [best()]
                    n = len(parts[0][0])
                    if n > HELD // 2:  # many requests: what they have goes on, and is merged later
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in parts[0]], ["anchor_id", "slot", "score", "vec_id"])
                        parts, n = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best()], ["anchor_id", "slot", "score", "vec_id"])

    met = packets.join(table.select("cell", "salt", "ids", "labels", "vectors"), ["cell", "salt"])
    return met.select("heads", "queries", "ids", "labels", "vectors").mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each request and their rank, from 1."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _uncertified(requests: DataFrame, found: DataFrame, keys: Keys, share: float, k: int) -> DataFrame:
    """Requests whose k-th best score doesn't exceed what the nearest unscanned ring can hold, where that ring matters."""
    worst = found.where(F.col("rank") == k).select("anchor_id", "slot", F.col("score").alias("kth"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                heads, q = _requests(batch, keys.width)
                order, best, _ = keys.plan(q)
                reach = keys.reach(order, share)
                left = np.where(reach < (keys.size > 0).sum(), best[np.arange(len(q)), np.minimum(reach, best.shape[1] - 1)], -np.inf)
                kth = batch.column("kth").to_numpy(zero_copy_only=False).astype(np.float64)
                more = (left >= heads["low"]) & ~(kth > left)
                yield batch.select([c for c in batch.schema.names if c != "kth"]).filter(pa.array(more))

    columns = [c.strip().split()[0] for c in REQUESTS.split(",")]
    return requests.join(worst, ["anchor_id", "slot"], "left").select(*columns, F.col("kth").cast("double").alias("kth")).mapInArrow(run, REQUESTS)


def search(requests: DataFrame, table: DataFrame, keys: Keys, same: bool, k: int) -> DataFrame:
    """anchor_id, slot, score, vec_id and rank of the k best rows of each request: of its label if same, else of another one."""
    found, done = None, 0.0
    for share in SHARES:
        hits = _scan(_packets(requests, keys, done, share), table, keys, same, k)
        found = staged(_best(hits if found is None else found.drop("rank").unionByName(hits), k))
        if share < 1:
            requests, done = staged(_uncertified(requests, found, keys, share, k)), share
            if requests.isEmpty():
                break
    return found


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = (30, 90), relabel: Column | None = None, scale: int = SCALE) -> DataFrame:
    """Per anchor (vec_id divisible by every), each of its best positives and each of the best rows of other labels whose score lies within the band, in percent of the positive's:
    anchor_id, positive_id, rank, negative_id, positive_score and negative_score."""
    spark = rows.sparkSession
    vectors = packed(eligible(rows, relabel), scale)
    n, width, most, square = _bounds(vectors)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n:
        return empty
    sample = bounded_sample(vectors, "vec_id", SAMPLE).select("data").collect()
    keys = Keys(_matrix([bytes(r[0]) for r in sample], width), width, most, square)
    table = stored(vectors, keys, f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    chosen = packed(eligible(rows.where(F.col("vec_id") % every == 0), relabel), scale).groupBy("vec_id").agg(F.min(F.struct("label", "data")).alias("x"))
    anchors = staged(chosen.select(F.col("vec_id").alias("anchor_id"), "x.label", "x.data"))
    wanted = anchors.select("anchor_id", F.lit(0).cast("long").alias("slot"), "label", F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high"), "data")
    near = search(wanted, table, keys, True, positives)
    pairs = near.select("anchor_id", F.col("rank").cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    hundredths = lambda percent: F.expr(f"(positive_score * {percent} - pmod(positive_score * {percent}, 100)) div 100")  # noqa: E731  rounded down, in whole numbers
    bounded = pairs.join(anchors, "anchor_id").withColumns({"low": -hundredths(-band[0]), "high": hundredths(band[1])}).where("low <= high")
    far = search(bounded.select("anchor_id", "slot", "label", "low", "high", "data"), table, keys, False, negatives)
    return pairs.join(far.withColumnRenamed("vec_id", "negative_id"), ["anchor_id", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", F.col("score").alias("negative_score"))


#: Over tables whose vectors have equally many components.
ORACLE = """WITH v AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10"""
