"""Facts with provenance: gate, report, latest row per key, counts; and pages turned into facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.text import clean_text, snippet

REQUIRED = ("source_url", "extracted_at", "raw_snippet", "fact_type", "content")
#: A text fact has at least so many characters.
TEXT_LEAST = 200
# Domains whose tables are taken.
TABLE_DOMAINS = ("fbref.com", "understat.com", "transfermarkt", "worldfootball.net")


def rejection(row: DataFrame | None = None) -> Column:
    """Why a fact is turned away, the first reason that holds; null if it is accepted."""
    reason = F.lit(None).cast("string")
    found = F.when(F.lit(False), reason)
    for name in REQUIRED:
        found = found.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(f"missing:{name}"))
    found = found.when(~F.col("source_url").startswith("http"), F.lit("bad:source_url"))
    return found.when(~F.col("extracted_at").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z?$"), F.lit("bad:extracted_at"))


def provenance(facts: DataFrame) -> DataFrame:
    """One row: accepted, rejected and their rate (1 without facts)."""
    reason = rejection()
    counts = facts.agg(F.count(F.when(reason.isNull(), 1)).alias("accepted"), F.count(reason).alias("rejected"))
    return counts.withColumn("rate", F.coalesce(F.try_divide("accepted", F.col("accepted") + F.col("rejected")), F.lit(1.0)))


def rejections(facts: DataFrame) -> DataFrame:
    """Facts turned away by reason."""
    return facts.select(rejection().alias("reason")).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is greatest in the order columns.

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a key with many rows weighs no more than others."""
    rest = F.struct(*(c for c in rows.columns if c != key))
    return rows.groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("__r")).select(key, "__r.*").select(*rows.columns)


def fact_id(url: Column, kind: Column, content: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", url, kind, content), 256), 1, 32)


def text_facts(pages: DataFrame, text: Column, fetched_at: Column) -> DataFrame:
    """Pages (url, html) whose cleaned text is long enough, as article facts with JSON content."""
    body = clean_text(text)
    content = F.to_json(F.struct(body.alias("text"), F.length(body).alias("n_chars")))
    rows = pages.select(F.lit("article_text").alias("fact_type"), F.col("url").alias("source_url"), content.alias("content"), snippet(body).alias("raw_snippet"), fetched_at.alias("extracted_at"), F.length(body).alias("n_chars")).where(F.col("n_chars") >= TEXT_LEAST)
    return rows.withColumns({"fact_id": fact_id(F.col("source_url"), F.col("fact_type"), F.col("content")), "partition_date": F.substring("extracted_at", 1, 10)})


def client_rendered(html: Column) -> Column:
    """A page without a paragraph or an article: scripts draw it."""
    return ~html.rlike(r"(?i)<(p|article)[\s>]")


def extraction_state(html: Column, n_chars: Column) -> Column:
    """ok, js_rendered or texto_insuficiente."""
    return F.when(n_chars >= TEXT_LEAST, "ok").when(client_rendered(html), "js_rendered").otherwise("texto_insuficiente")


def counters(rows: DataFrame, bucket: Column, *keys: Column) -> DataFrame:
    """How often each key that isn't null came up in each bucket, in one pass; a row may count for several keys."""
    found = rows.select(bucket.alias("bucket"), F.explode(F.array(*keys)).alias("key")).where("key is not null")
    return found.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n"))
