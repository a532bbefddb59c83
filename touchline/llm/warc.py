"""WARC archives: writer with revisit records, normaliser of monolithic gzip streams, reader.

`write_pages` puts each page into a WARC archive that is one gzip stream as a whole.  `normalise` inflates such
a stream once, rewrites every record as a gzip member of its own and writes a sidecar index of their offsets
(JSON lines).  `read_records` seeks to the members by that index.  Tasks pass archives on by path: each
attempt writes files of its own, and only those of the attempt that succeeded are named in the manifest.

Nulls: a null payload counts as empty, a null url has no target header, a null page id comes after all
others: such a record is never referred to.  Rows that repeat a page id and its payload are all responses if
one is.  Empty tables give no archives.  Texts of any length are kept whole; a record must fit a task's memory.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import pieces, shared_dir, small_batches, staged

#: Payloads from this size on are stored once.
LEAST = 100
#: An archive is closed once its records have so many bytes.
ROLL = 256_000_000
LEVEL = 4
#: Revisits up to this number are broadcast (16 bytes and a digest each); beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS or an object store), and the path there."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One WARC record: a response, or, where first is given, a revisit of that page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if first is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if first is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page: {first}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def inflated(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip stream of one or more members, read once."""
    opened = zlib.decompressobj(31)
    while data := source.read(chunk):
        while data:
            if part := opened.decompress(data):
                yield part
            data = opened.unused_data
            if opened.eof:
                opened = zlib.decompressobj(31)


def records(parts: Iterator[bytes], name: str = "") -> Iterator[tuple[bytes, bytes]]:
    """Header and whole bytes of each record; an error where a stream breaks off or isn't WARC."""
    held = bytearray()

    def until(n: int) -> bool:
        while len(held) < n:
            if (more := next(parts, None)) is None:
                return False
            held.extend(more)
        return True

    while held or until(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not until(looked + 1):
                raise ValueError(f"{name}: a record's header breaks off")
        head = bytes(held[:end])
        length = [int(x[15:]) for x in head.split(b"\r\n") if x[:15].lower() == b"content-length:"]
        if not head.startswith(b"WARC/") or len(length) != 1:
            raise ValueError(f"{name}: not a WARC record: {head[:60]!r}")
        total = end + 4 + length[0] + 4
        if not until(total):
            raise ValueError(f"{name}: a record breaks off")
        yield head, bytes(held[:total])
        del held[:total]


def fields(head: bytes) -> dict[str, str]:
    """A header's fields by their lower-cased names."""
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def normalise_stream(source, target, name: str = "", level: int = LEVEL) -> Iterator[dict]:
    """Writes each record of source as its own gzip member to target; yields its index entry."""
    offset = 0
    for head, whole in records(inflated(source), name):
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = squeeze.compress(whole) + squeeze.flush()
        target.write(member)
        f = fields(head)
        yield {"offset": offset, "length": len(member), "type": f.get("warc-type"), "record_id": f.get("warc-record-id"), "url": f.get("warc-target-uri")}
        offset += len(member)


MANIFEST = "archive string, sidecar string, n_records long"


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, digest and first of the records that revisit another one, each pair once."""
    rows = pages.select("page_id", "digest").where(F.col("bytes") >= least).distinct()
    firsts = staged(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first"))
    small = firsts.count() <= BROADCAST_ROWS
    return staged(rows.join(F.broadcast(firsts) if small else firsts, "digest").where("page_id is null or page_id > first"))


def write_pages(pages: DataFrame, folder: str, least: int = LEAST, roll: int = ROLL, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes page_id, url, html as monolithic archives below folder; returns their manifest."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "bytes": F.length("payload").cast("long")})
    again = revisits(rows, least)
    small = again.count() <= BROADCAST_ROWS
    same = rows["page_id"].eqNullSafe(F.col("again_id")) & (rows["digest"] == F.col("again_digest"))
    again = again.select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first")
    joined = rows.join(F.broadcast(again) if small else again, same, "left").select("page_id", "url", "payload", "digest", "first")

    def run(batches):
        place, root = store(folder)
        place.create_dir(root)
        out, name, size, n, squeeze, done = None, "", 0, 0, None, []

        def close():
            out.write(squeeze.flush())
            out.close()
            done.append((f"{folder}/{name}", n))

        for batch in pieces(batches, 128):
            for row in batch.to_pylist():
                if out is None:
                    name, size, n = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, squeeze = place.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["first"], date)
                out.write(squeeze.compress(data))
                size, n = size + len(data), n + 1
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"archive": [x for x, _ in done], "sidecar": [None] * len(done), "n_records": [x for _, x in done]}, pa.schema([("archive", pa.string()), ("sidecar", pa.string()), ("n_records", pa.int64())]))

    return staged(joined.mapInArrow(run, MANIFEST))


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrites the archives of a manifest below folder, with sidecars; returns the new manifest."""

    def run(batches):
        place, root = store(folder)
        place.create_dir(root)
        for batch in batches:
            done = []
            for archive in batch.column("archive").to_pylist():
                source, path = store(archive)
                name, n = uuid.uuid4().hex, 0
                with source.open_input_stream(path, compression=None) as read, place.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as write, place.open_output_stream(f"{root}/{name}.index.jsonl") as index:
                    for entry in normalise_stream(read, write, archive):
                        index.write(json.dumps(entry).encode() + b"\n")
                        n += 1
                done.append((f"{folder}/{name}.warc.gz", f"{folder}/{name}.index.jsonl", n))
            yield pa.RecordBatch.from_pydict({"archive": [x[0] for x in done], "sidecar": [x[1] for x in done], "n_records": [x[2] for x in done]}, pa.schema([("archive", pa.string()), ("sidecar", pa.string()), ("n_records", pa.int64())]))

    return staged(manifest.mapInArrow(run, MANIFEST))


RECORD = "archive string, offset long, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_records(manifest: DataFrame) -> DataFrame:
    """The records of normalised archives, each read by its offset; a response's digest is taken from its payload."""
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def parsed(archive: str, entry: dict, member: bytes) -> tuple:
        ((head, whole),) = records(iter([zlib.decompress(member, 31)]), archive)
        f = fields(head)
        block = whole[len(head) + 4 : -4]
        payload = block[block.index(b"\r\n\r\n") + 4 :] if f["warc-type"] == "response" else None
        length, digest = int(f["x-payload-length"]), f["warc-payload-digest"].removeprefix("sha256:")
        if payload is not None:
            length, digest = len(payload), hashlib.sha256(payload).hexdigest()
        number = lambda x: int(x) if x is not None else None
        return archive, entry["offset"], number(f.get("x-page-id")), f.get("warc-target-uri"), f["warc-type"], payload, length, digest, number(f.get("x-refers-to-page"))

    def run(batches):
        for batch in batches:
            for archive, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
                (source, path), (place, index) = store(archive), store(sidecar)
                rows: list[tuple] = []
                with source.open_input_file(path) as read, place.open_input_stream(index, compression=None) as lines:
                    held = b""
                    while part := lines.read(1 << 20):
                        *whole, held = (held + part).split(b"\n")
                        for entry in map(json.loads, whole):
                            read.seek(entry["offset"])
                            rows.append(parsed(archive, entry, read.read(entry["length"])))
                            if len(rows) == 128:
                                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                                rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return manifest.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Pages written, normalised and read back: a row per page."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_records(normalise(write_pages(pages, f"{folder}/whole", least), f"{folder}/members"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM p JOIN f USING (payload_digest)
"""
