"""Crawled URLs: records, first-seen deduplication, caps and samples by domain, sitemaps and feeds that were landed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.text import url_class, url_hash, url_host, url_normal, url_on_topic


def records(urls: DataFrame, seeds: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Normalised on-topic URLs with host, hash, category and, by a broadcast of the seeds (domain, language, region,
    default_category), the seed's attributes."""
    rows = urls.withColumn("url", url_normal(F.col(url))).where(url_on_topic(F.col("url")))
    rows = rows.withColumns({"domain": url_host(F.col("url")), "url_hash": url_hash(F.col("url"))})
    if seeds is not None:
        rows = rows.join(F.broadcast(seeds), "domain", "left")
    default = F.coalesce(F.col("default_category"), F.lit("noticias")) if seeds is not None else "noticias"
    return rows.withColumn("class", url_class(F.col("url"), default)).select("*", "class.*").drop("class")


def unseen(rows: DataFrame, seen: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in that order that isn't among the seen keys; one row per key and task is shuffled."""
    rest = F.struct(*(c for c in rows.columns if c != key))
    fresh = rows.groupBy(key).agg(F.min_by(rest, F.struct(*order)).alias("__r")).select(key, "__r.*").select(*rows.columns)
    return fresh.join(seen.select(key).distinct(), key, "left_anti")


def domain_caps(rows: DataFrame, cap: int, target: int, order: str, domain: str = "domain") -> DataFrame:
    """At most cap rows of each domain in that order, and of those the first target rows.

    Spark limits each domain to cap rows within the tasks already (a window group limit), and takes the target from sorted tops."""
    kept = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(domain).orderBy(order))).where(F.col("__rn") <= cap)
    return kept.drop("__rn").orderBy(order).limit(target)


def cap_for(target: int, seeds: int) -> int:
    return max(50, -(-target // seeds) * 2)


def round_robin(rows: DataFrame, limit: int, order: str, domain: str = "domain") -> DataFrame:
    """A sample that takes the domains in turn, those seen first first, until limit rows.

    No domain gives more than limit rows, which bounds what a large one sends."""
    first = rows.groupBy(domain).agg(F.min(order).alias("__first"))
    turns = rows.withColumn("__turn", F.row_number().over(Window.partitionBy(domain).orderBy(order))).where(F.col("__turn") <= limit)
    return turns.join(first, domain).orderBy("__turn", "__first", order).limit(limit).select(*rows.columns)


def sitemap_links(robots: DataFrame, text: str = "text") -> DataFrame:
    """The sitemaps that landed robots.txt files name."""
    line = F.explode(F.split(F.col(text), r"\r?\n")).alias("line")
    return robots.select(*[c for c in robots.columns if c != text], line).where(F.lower(F.trim("line")).startswith("sitemap:")).withColumn("sitemap", F.trim(F.regexp_replace("line", r"(?i)^\s*sitemap:", ""))).drop("line")


def locations(xml: Column) -> Column:
    """The <loc> values of a sitemap or sitemap index."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda x: F.regexp_replace(x, "&amp;", "&"))


def feed_links(xml: Column) -> Column:
    """The <link> values of a feed's items."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<item[\s>].*?</item>"), 0)
    return F.filter(F.transform(items, lambda x: F.regexp_extract(x, r"(?is)<link>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</link>", 1)), lambda x: x != "")


def expand_sitemaps(roots: DataFrame, landed: DataFrame, depth: int = 3, children: int = 500) -> DataFrame:
    """Page URLs below the roots (sitemap), by landed sitemaps (url, xml); an index adds its first children as the next level."""
    level, pages = roots.select(F.col("sitemap").alias("url")).distinct(), None
    for _ in range(depth + 1):
        met = level.join(landed, "url").withColumn("locs", locations(F.col("xml")))
        index = F.col("xml").rlike("(?i)<sitemapindex")
        found = met.where(~index).select(F.explode("locs").alias("url"))
        pages = found if pages is None else pages.unionByName(found)
        level = met.where(index).select(F.explode(F.slice("locs", 1, children)).alias("url")).distinct()
    return pages.distinct()


def cache_state(events: DataFrame, key: str, order: str, keep_last: tuple[str, ...], keep_known: tuple[str, ...]) -> DataFrame:
    """The state an upsert log leaves: of keep_last the last value, of keep_known the last that isn't null."""
    last = lambda c, known: F.max_by(c, F.struct(F.col(c).isNotNull(), F.col(order)) if known else F.col(order)).alias(c)
    return events.groupBy(key).agg(*(last(c, False) for c in keep_last), *(last(c, True) for c in keep_known))


def cache_totals(state: DataFrame, body: str = "body") -> DataFrame:
    """How many pages a cache holds, and how many of them with a body."""
    return state.agg(F.count(F.lit(1)).alias("total"), F.count(body).alias("with_body"))
