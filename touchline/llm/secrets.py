"""Secret scan with a recursive decoding worklist.

Each text is scanned for assignments, access keys and long hexadecimal runs.  Then URL escapes, Unicode
escapes, base64 runs and the gzip or zlib streams inside them are unwrapped, each result is scanned in its
turn and unwrapped again until nothing new appears; layers that were seen before are not entered twice.
Every finding is mapped to the code points of the original text that it comes from.

Nulls: a null text counts as empty and has no findings; a null id is kept.  Empty tables give empty
results; repeated rows are scanned each for itself; other columns are ignored.

Base64 runs are read in all alignments in which a part behind a separator (/, -, _, +) begins, and streams are looked for behind
each separator.  Layers needn't be text: bytes that aren't UTF-8 become replacement characters, and the rest is scanned.
Compressed streams are opened with all their members and whatever their size, in pieces of PIECE characters that
are cut where no finding or layer can go on.  A run of over 4 * PIECE characters without such a place is cut with an
overlap of PIECE, and a base64 run that reaches over the cut is decoded as a stream, from the layer's source read again, so that what it
holds stays whole whatever its length.  Only an escape run (%41%42...) of more than PIECE characters within such a layer is seen in parts.
A base64 run goes on over single line breaks; over several lines it is read from the first character of its first or second line.  Behind a separator a stream counts only if it opens; other data there is part of its alignment's.

Of hexadecimal runs in a reading from behind a separator, those of fewer than DISTINCT different characters are left out.

Findings of an escape come from that escape's characters, those of a base64 run from the whole run.  Ties: of the same finding by
several ways the first way counts.  Very long texts are scanned whole; a layer keeps one span, not one for each character.
"""

from __future__ import annotations

import base64
import codecs
import itertools
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import column_bytes, pieces, small_batches

KINDS = ("assign", "access", "hex")
#: Different characters that a hexadecimal run must have in a reading that starts behind a separator, where repeated bytes look like one by chance.
DISTINCT = 8
#: Characters of a layer scanned at once, and bytes that are inflated at once.
PIECE, CHUNK = 4_000_000, 1 << 16
_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_URL, _UNICODE = re.compile(r"(?:%[0-9A-Fa-f]{2})+"), re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})+")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[A-Za-z0-9+/_-]+)+={0,2}")
_GOES_ON = re.compile(r"(?:[A-Za-z0-9+/_-]++|\r?\n(?=[A-Za-z0-9+/_-]))*+")
_SEPARATOR = re.compile(r"[+/_-]")
_LINE, _FIRST = re.compile(r"\r?\n"), re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}")
#: What ends a base64 run: another character, or an empty line.
_ENDS = re.compile(r"[^A-Za-z0-9+/_\r\n-]|(?<=\n)\n|(?<=\n\r)\n|(?<=\r)(?=[^\n])")
#: Characters that no finding and no layer contains.
_OUTSIDE = re.compile(r"[^A-Za-z0-9+/_.=:%\\\"'\x20\r\n\u017f\u212a-]")
_CODE = re.compile(r"\\[ux]([0-9A-Fa-f]+)")
_KEYS = ("passw", "secret", "token", "apikey", "api_key")
_WORDS = tuple(x.encode() for x in _KEYS)

#: Characters that text doesn't have.
_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]")

Span = tuple[str, int, int]


class Origin:
    """Where the characters of a layer come from: all from one span, or each from its own (arrays of starts and ends; none for the text itself)."""

    def __init__(self, span: tuple[int, int] | None = None, each: tuple[np.ndarray, np.ndarray] | None = None):
        self.span_, self.each = span, each

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The span that characters a to b (exclusive) come from."""
        if self.span_:
            return self.span_
        return (a, b) if self.each is None else (int(self.each[0][a]), int(self.each[1][b - 1]))

    def part(self, a: int, b: int) -> list[np.ndarray]:
        return [np.arange(a, b), np.arange(a + 1, b + 1)] if self.each is None else [x[a:b] for x in self.each]

    def key(self) -> tuple | bytes | None:
        return self.span_ or (self.each and xxhash.xxh3_128_digest(b"".join(x.tobytes() for x in self.each)))


def find(text: str) -> list[Span]:
    """The base findings of a text: per kind leftmost and non-overlapping, then those that are long enough."""
    lower = text.lower()
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8] if any(w in lower for w in _KEYS) else []
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def _surrogates(text: str) -> str:
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _unescaped(pattern: re.Pattern, decode, text: str, origin: Origin) -> tuple[str, Origin]:
    """The text with each match replaced by its decoding; new characters come from the whole match."""
    out, each, at = [], ([], []), 0
    for m in pattern.finditer(text):
        new = decode(m[0])
        out += [text[at : m.start()], new]
        if not origin.span_:
            for x, kept, edge in zip(each, origin.part(at, m.start()), origin.span(*m.span()), strict=True):
                x += [kept, np.full(len(new), edge)]
        at = m.end()
    out.append(text[at:])
    if origin.span_:
        return "".join(out), origin
    first, last = (np.concatenate([*x, rest]) for x, rest in zip(each, origin.part(at, len(text)), strict=True))
    return "".join(out), Origin(each=(first, last))


def _url(run: str) -> str:
    return bytes.fromhex(run.replace("%", "")).decode("utf-8", "replace")


def _codes(run: str) -> str:
    return _surrogates("".join(chr(int(x, 16)) for x in _CODE.findall(run)))


def _packed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or len(data) > 2 and data[0] == 0x78 and (data[0] * 256 + data[1]) % 31 == 0


def _members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What the gzip or zlib members hold that follow each other in the chunks, up to the first fault."""
    stream, rest = zlib.decompressobj(47), b""
    for chunk in itertools.chain(chunks, [b""]):
        rest += chunk
        while rest or not chunk and not stream.eof:
            if stream.eof:
                if len(rest) < 3:
                    break
                if not _packed(rest):
                    return
                stream = zlib.decompressobj(47)
            try:
                out = stream.decompress(rest, CHUNK)
            except zlib.error:
                return
            rest = stream.unused_data if stream.eof else stream.unconsumed_tail
            if out:
                yield out
            elif not rest:
                break


def _opened(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The chunks with gzip and zlib streams opened, layer by layer; what can't be opened stays as it is."""
    head = b""
    while len(head) < 3 and (chunk := next(chunks, b"")):
        head += chunk
    if not _packed(head):
        yield head
        yield from chunks
        return
    read = [head]

    def more():
        yield head
        for chunk in chunks:
            read.append(chunk)
            yield chunk
            read[1:] = read[1:] if unopened else []

    unopened = True
    inner = _members(more())
    first = next(inner, None)
    if first is None:
        yield from read
        yield from chunks
        return
    unopened = False
    yield from _opened(itertools.chain([first], inner))


def _opens(data: memoryview) -> bool:
    """Whether a stream begins here that gives anything before its first fault."""
    try:
        stream = zlib.decompressobj(47)
        return len(stream.decompress(data[:CHUNK], 1)) > 0 or not stream.eof and len(data) > CHUNK
    except zlib.error:
        return False


def _chunks(data: bytes) -> Iterator[bytes]:
    return (data[i : i + CHUNK] for i in range(0, len(data), CHUNK))


def _texts(chunks: Iterator[bytes]) -> Iterator[str]:
    """The text of the chunks, opened if they are packed."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in _opened(chunks):
        yield decoder.decode(chunk)
    yield decoder.decode(b"", True)


def _last(pattern: re.Pattern, text: str, low: int, high: int) -> int:
    """Where the last match between two places ends; the lower one without any."""
    width = 64
    while high > low:
        start = max(high - width, low)
        if ends := [m.end() for m in pattern.finditer(text, start, high)]:
            return ends[-1]
        high, width = start, min(2 * width, CHUNK)
    return low


class Part(str):
    """A part of a layer: the character that it begins with, and whether something goes on over its start and its end."""

    at, begun, goes_on = 0, False, False

    @classmethod
    def of(cls, text: str, at: int, begun: bool, goes_on: bool) -> Part:
        part = cls(text)
        part.at, part.begun, part.goes_on = at, begun, goes_on
        return part


def _parts(texts: Iterator[str]) -> Iterator[Part]:
    """The text in parts of about PIECE characters, cut where nothing goes on.  Parts between which there is no such place overlap by PIECE."""
    held, size, at, begun, wait = [], 0, 0, False, PIECE
    for text in texts:
        held.append(text)
        size += len(text)
        if size < wait:
            continue
        whole = "".join(held)
        last, kept = _last(_OUTSIDE, whole, 0, len(whole)), len(whole)
        if last:
            yield Part.of(whole[:last], at, begun, False)
            kept, begun, wait = len(whole) - last, False, PIECE
        elif size > 4 * PIECE:
            yield Part.of(whole, at, begun, True)
            kept, begun, wait = PIECE, True, 2 * PIECE
        else:
            wait = 2 * size
        at += len(whole) - kept
        held, size = [whole[len(whole) - kept :]], kept
    yield Part.of("".join(held), at, begun, False)


def _bytes(run: str) -> bytes:
    """What a base64 run of either alphabet encodes; a last character that is one too many is left out."""
    body = "".join(run.split()).rstrip("=").replace("-", "+").replace("_", "/")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _decoded(source: Callable[[], Iterator[str]], start: int) -> Iterator[bytes]:
    """What the base64 run at that character of a layer encodes, over single line breaks, in chunks."""
    body, gap = "", ""
    for text in source():
        if start >= len(text):
            start -= len(text)
            continue
        text, start = gap + text[start:], 0
        end = _GOES_ON.match(text).end()
        body, gap = body + "".join(text[:end].split()), text[end:]
        whole = len(body) // 4 * 4
        yield _bytes(body[:whole])
        body = body[whole:]
        if gap not in ("", "\r", "\n", "\r\n"):
            break
    yield _bytes(body)


def _reaching(layer: str, low: int) -> int | None:
    """Where the base64 run begins that reaches the layer's end, over single line breaks."""
    m = _FIRST.search(layer, _last(_ENDS, layer, low, len(layer)))
    return m and m.start()


def _long_starts(run: str, at: int, first: int, known: dict[int, int]) -> Iterator[int]:
    """Characters of a layer at which readings of its run begin that reaches over a cut; `run` is what a part that begins at `at` has of it, `first` the
    run's first character.  Starts are chosen as in _readings, and known has the first one of each alignment; a run over lines is read from
    its first and from its second line."""
    if line := _LINE.search(run):
        for place in (at, at + line.end()) if at == first and not known else ():
            known[place - at] = place
            yield place
        return
    local: dict[int, tuple[int, memoryview]] = {}
    for start in (0, *(m.end() for m in _SEPARATOR.finditer(run))):
        place = at + start
        if start == 0 and place != first or len(run) - start < 16:
            continue
        turn = (place - first) % 4
        if turn not in known:
            known[turn] = place
            yield place
        elif place > known[turn]:
            if turn not in local:
                local[turn] = start, memoryview(_bytes(run[start:]))
            data = local[turn][1][(start - local[turn][0]) // 4 * 3 :]
            if _packed(data[:3]) and _opens(data):
                yield place


def _is_text(data: bytes) -> bool:
    """Whether the data, opened, is text but for a few characters."""
    size = odd = 0
    for text in _texts(_chunks(data)):
        size, odd = size + len(text), odd + len(_ODD.findall(text))
    return size > 0 and odd <= 0.05 * size


def _readings(run: str) -> Iterator[tuple[bytes, bool]]:
    """The data of a run: from its first character on, from the first start behind a separator in each other alignment, and the streams
    that begin behind a separator; and whether it isn't from the first character on.  Of starts in one alignment the first one's data holds the others' too."""
    known: dict[int, tuple[int, bytes]] = {}
    for start in (0, *(m.end() for m in _SEPARATOR.finditer(run))):
        if len(run) - start < 16:
            break
        if start % 4 not in known:
            known[start % 4] = start, _bytes(run[start:])
            yield known[start % 4][1], start > 0
        else:
            first, data = known[start % 4]
            at = (start - first) // 4 * 3
            if _packed(data[at : at + 3]) and _opens(memoryview(data)[at:]):
                yield data[at:], True


def _runs(layer: str) -> Iterator[tuple[int, int, bytes, bool]]:
    """Start, end and data of base64 runs, and whether they are read from behind a separator: first those over several lines, of which the first or last line may be another word, then others."""
    if not _FIRST.search(layer):
        return
    known: list[tuple[int, int]] = []
    for m in _WRAPPED.finditer(layer):
        lines = [(x.start() + m.start(), x.end() + m.start()) for x in re.finditer(r"[^\r\n]+", m[0])]
        width = max(b - a for a, b in lines[:2])
        lines = lines[: next((i for i, (a, b) in enumerate(lines) if i and b - a < width), len(lines)) + 1]
        for first, last in ((0, 0), (0, 1), (1, 0), (1, 1)):
            use = lines[first : len(lines) - last]
            if len(use) > 1 and _is_text(data := _bytes(layer[use[0][0] : use[-1][1]])):
                known.append((use[0][0], use[-1][1]))
                yield *known[-1], data, False
                break
        else:
            yield lines[0][0], lines[-1][1], _bytes(layer[lines[0][0] : lines[-1][1]]), False
    k = 0
    for m in _BASE64.finditer(layer):
        while k < len(known) and known[k][1] <= m.start():
            k += 1
        if k == len(known) or m.start() < known[k][0]:
            for data, behind in _readings(m[0]):
                yield m.start(), m.end(), data, behind


def _beside(pattern: re.Pattern, layer: str) -> str:
    """The stretches of a layer between characters that nothing contains, of which those with a match."""
    if not _OUTSIDE.search(layer):
        return layer
    found, at = [], 0
    for m in pattern.finditer(layer):
        if m.start() < at:
            continue
        begin, end = _last(_OUTSIDE, layer, at, m.start()), _OUTSIDE.search(layer, m.end())
        at = end.end() if end else len(layer)
        found.append(layer[begin:at])
    return "".join(found)


def scan(text: str) -> list[tuple[str, int, int, str]]:
    """All findings as kind, start, end and the path of layers ("" for the base), by start, kind and end."""
    found: dict[Span, str] = {}
    todo, seen = deque([(lambda: iter([text]), Origin(), "", False)]), set()
    while todo:
        source, origin, path, shifted = todo.popleft()
        # a text, and what its escapes give, is one part; only data of base64 runs is read in several
        parts = _parts(source()) if origin.span_ else map(Part, source())
        chain, long_run, starts, waiting = b"", None, {}, []
        for layer in parts:
            at, begun, goes_on = layer.at, layer.begun, layer.goes_on
            chain = xxhash.xxh3_128_digest((chain if begun else b"") + layer.encode("utf-8", "surrogatepass"))
            low, high, key = 0, len(layer), (chain, origin.key(), goes_on)
            if begun:
                low = _GOES_ON.match(layer).end()
                if low and long_run is not None and long_run <= at:
                    waiting += [(start, True) for start in _long_starts(layer[:low], at, long_run, starts)]
            if goes_on and low < high:
                start = _reaching(layer, low)
                if start is None or at + start != long_run:
                    long_run, starts = None if start is None else at + start, {}
                if start is not None:
                    high = start
                    waiting += [(x, x > long_run) for x in _long_starts(layer[high:], at + high, long_run, starts)]
            if not layer or key in seen:
                continue
            seen.add(key)
            todo.extend((_stream(source, start), origin, f"{path}/base64", shifted or behind) for start, behind in waiting)
            waiting = []
            for kind, a, b in find(layer):
                if kind == "hex" and shifted and len(set(layer[a:b])) < DISTINCT:
                    continue
                found.setdefault((kind, *origin.span(a, b)), path)
            for name, mark, pattern, decode in (("url", "%", _URL, _url), ("unicode", "\\", _UNICODE, _codes)):
                if mark in layer and pattern.search(layer):
                    new, whence = _unescaped(pattern, decode, _beside(pattern, layer) if origin.span_ else layer, origin)
                    todo.append((lambda new=new: iter([new]), whence, f"{path}/{name}", shifted))
            for a, b, data, behind in _runs(layer if (low, high) == (0, len(layer)) else layer[low:high]):
                todo.append((lambda data=data: _texts(_chunks(data)), Origin(span=origin.span(low + a, low + b)), f"{path}/base64", shifted or behind))
    return sorted(((*k, p) for k, p in found.items()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _stream(source: Callable[[], Iterator[str]], start: int) -> Callable[[], Iterator[str]]:
    return lambda: _texts(_decoded(source, start))


def may_hold(data: bytes) -> bool:
    """False only where neither a layer nor a finding is possible: every one has a key word, an escape or a run of 16 characters."""
    lower = data.lower()
    return any(w in lower for w in _WORDS) or b"\\u" in data or b"\\x" in data or (b"%" in data and _URL.search(data.decode("utf-8", "replace")) is not None) or any(len(w) >= 16 for w in data.split())


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id and findings (kind, start, end, path), in code points of the text."""
    small_batches(docs.sparkSession)
    finding = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("path", pa.string())])

    def run(batches):
        for batch in pieces(batches):
            rows = [[dict(zip(("kind", "start", "end", "path"), x, strict=True)) for x in scan(d.decode("utf-8", "replace"))] if d and may_hold(d) else [] for d in column_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(finding))], ["doc_id", "findings"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, findings array<struct<kind string, start long, end long, path string>>")


def secret_digest(docs: DataFrame) -> DataFrame:
    """The findings' digest columns: counts and hash of the base ones, and all spans as text."""
    base = F.filter("findings", lambda x: x["path"] == "")
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    return scan_secrets(docs).select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", line), ",").alias("spans"),
    )
