"""Fill-in-middle transformation: a text is cut in three at code points, and its middle is moved to the end.

The tokenizers library's Split pre-tokenizer, with a pattern that matches one code point and isolates every match, gives the
offsets of a text's units; nothing is trained.  The length of the array of offsets is n, and offsets by rank are where slices
end.  A match never depends on its neighbours, so a text may be handed to the pre-tokenizer in pieces of PIECE code points: what it says
of a piece is remembered by the worker (for PIECES of them at most) and shifted to where the piece stands.

Three draws of a document come from its id alone, so a result never depends on how rows are dealt to tasks.  Sentinels can't
overlap themselves or each other, so the first one found behind the last is the right one, and restored() is exact.

Nulls: a null text counts as empty, and empty texts stay plain; a null id draws as an empty one and stays null.  Very long texts
are cut whole, in steps of STEP code points; the offsets take four bytes a code point.  Repeated rows give equal rows.  Empty
tables give empty results.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from touchline.llm.common import in_use, pieces, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of texts that stay plain, and of the others those with the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Code points of a text that are cut at once, of a piece whose offsets are remembered, and pieces that a worker remembers.
STEP, PIECE, PIECES = 65_536, 4, 400_000
_PIECE = re.compile(r"[\s\S]{1,%d}" % PIECE)
_UNIT = Split(Regex(r"[\s\S]"), "isolated")


class _Ends(dict):
    """A piece of text to where its units end, as the bytes of 32-bit numbers."""

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ends = np.array([end for _, (_, end) in _UNIT.pre_tokenize_str(piece)], np.int32).tobytes()
        return ends


_ends = _Ends()


def unit_ends(text: str) -> np.ndarray:
    """Where each unit (code point) of the text ends."""
    found, start = [np.empty(0, np.int32)], 0
    while start < len(text):
        parts = list(map(_ends.__getitem__, _PIECE.findall(text, start, start + STEP)))
        ends = np.frombuffer(b"".join(parts), np.int32)
        count = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        long = ends[np.cumsum(count) - 1]
        found.append(ends + np.repeat(start + np.cumsum(long, dtype=np.int32) - long, count))
        start = int(found[-1][-1])
    return np.concatenate(found)


def draws(doc_id: int | None, seed: str = "1") -> list[int]:
    """Four numbers under 2**32 by seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transformed(text: str, doc_id: int | None, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, seed: str = "1") -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, and the output."""
    ends = unit_ends(text)
    n, (h1, h2, h3, h4) = len(ends), draws(doc_id, seed)
    if not n or h3 % 100 >= 100 - plain or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[r - 1]) if r else 0 for r in (first, last))
    if h4 % 100 < suffix_first:
        return n, "spm", first, last - first, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", first, last - first, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def fill_in_middle(docs: DataFrame, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, seed: str = "1") -> DataFrame:
    """Per row of docs: doc_id, n (code points), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output, the text to train on."""
    small_batches(docs.sparkSession)
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])

    def run(batches):
        for batch in pieces(batches):
            in_use(_ends, PIECES)
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            rows = [transformed(x or "", i, plain, suffix_first, seed) for i, x in zip(ids.to_pylist(), texts, strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(list(c), t.type) for c, t in zip(columns, list(kinds)[1:], strict=True))], schema=kinds).cast(pa.schema([*list(kinds)[:-1], ("output", pa.string())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, by its sentinels alone."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.expr(f"substring({output}, {len(first) + 1})")
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substr(rest, F.length(b) + len(MIDDLE) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    s_suffix, s_prefix, s_middle = parts(SUFFIX, PREFIX)
    return F.when(F.col(form) == "psm", F.concat(prefix, middle, suffix)).when(F.col(form) == "spm", F.concat(s_prefix, s_middle, s_suffix)).otherwise(F.col(output))


def digest(docs: DataFrame) -> DataFrame:
    """fill_in_middle() with hashes of the output and of what is restored from it instead of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = fill_in_middle(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


ORACLE = """WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
 CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4 FROM d),
f AS (SELECT *, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS a, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS b,
 CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM g"""
