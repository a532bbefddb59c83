"""Site-relative line deduplication, in DataFrame functions.

A line's ratio on a host is the number of the host's pages that contain it over all pages of the host; lines
beyond the ratio are dropped from those pages.  Lines are parted by newlines and compared whole, by a 64-bit
hash; lines of white space alone are neither counted nor dropped.  A line that is on one page only repeats nothing and
stays, whatever its ratio (on a host of nine pages it would be 0.11).

Three switches are off unless asked for: hosts with fewer than `least_pages` pages keep all lines, lines on fewer than
`least_count` pages stay, and `spare_emptied` leaves pages whole that would keep no word.

Nulls: a null text stays null and has no lines; a null host is a host of its own.  Empty tables give empty
results.  Repeated rows count as pages of their own.  Ties: a line at the ratio itself stays.  Very long texts are split
within their row.  Other columns are returned as they are; helper columns are named so that they don't meet others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import staged

RATIO, REPEATED = 0.1, 2
_WORD = "[^\\x20\\x09-\\x0D]"
#: Boilerplate lines of all hosts up to this number are broadcast (8 bytes each); beyond it hosts are joined by shuffle.
BROADCAST_LINES, SALTS = 500_000, 32


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = 0, least_count: int = REPEATED) -> DataFrame:
    """A row per host with boilerplate: __host and the hashes __lines."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(_WORD)), lambda x: F.xxhash64(x))
    counts = docs.select(F.col(host).alias("__host"), F.explode(F.array_distinct(lines)).alias("__line")).groupBy("__host", "__line").agg(F.count(F.lit(1)).alias("__n"))
    totals = docs.groupBy(F.col(host).alias("__host0")).agg(F.count(F.lit(1)).alias("__pages")).where(F.col("__pages") >= least_pages)
    often = counts.join(totals, F.col("__host").eqNullSafe(F.col("__host0"))).where((F.col("__n") >= least_count) & (F.col("__n") > F.lit(ratio) * F.col("__pages")))
    return often.groupBy("__host").agg(F.sort_array(F.collect_list("__line")).alias("__lines"))


def line_dedup(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = 0, least_count: int = REPEATED, spare_emptied: bool = False) -> DataFrame:
    """docs with the boilerplate lines gone from text, and the numbers of lines __n_lines and __n_dropped."""
    known = staged(boilerplate(docs, host, text, ratio, least_pages, least_count))
    size = known.agg(F.coalesce(F.sum(F.size("__lines")), F.lit(0))).first()[0]
    if size <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(known), docs[host].eqNullSafe(known["__host"]), "left")
    else:
        salted = docs.withColumn("__salt", F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int"))
        copies = known.withColumn("__salt0", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, salted[host].eqNullSafe(copies["__host"]) & (F.col("__salt") == F.col("__salt0")), "left").drop("__salt", "__salt0")
    lines = F.split(text, "\n")
    keep = F.filter(lines, lambda x: ~F.array_contains("__lines", F.xxhash64(x)))
    kept = F.when(F.col("__lines").isNull(), lines).otherwise(keep)
    cut = joined.withColumn("__kept", kept)
    if spare_emptied:
        cut = cut.withColumn("__kept", F.when(F.exists("__kept", lambda x: x.rlike(_WORD)), F.col("__kept")).otherwise(lines))
    return cut.withColumns({"__n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "__n_dropped": F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).cast("long"), text: F.array_join("__kept", "\n")}).drop("__kept", "__lines", "__host")


ORACLE = f"""
WITH l AS (SELECT DISTINCT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
n AS (SELECT source, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
b AS (SELECT n.source, list(line) AS often FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source WHERE n >= {REPEATED} AND n > {RATIO} * pages GROUP BY n.source),
d AS (SELECT doc_id, string_split(text, chr(10)) AS lines, coalesce(often, []::VARCHAR[]) AS often FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source),
k AS (SELECT doc_id, lines, [x FOR x IN lines IF NOT list_contains(often, x)] AS kept FROM d)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
"""
