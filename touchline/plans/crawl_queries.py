"""Queries over facts, URLs and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import text
from touchline.operators import crawl, facts, pages
from touchline.plans.base import longs, query
from touchline.plans.fixtures import FACTS, Tables

_F = f"WITH f AS ({FACTS}), "
_LATEST = _F + "l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY doc_id DESC) = 1) "


def _latest(t: Tables) -> DataFrame:
    return facts.latest(t.sql(FACTS), "fact_id", "doc_id")


@query(_LATEST + "SELECT fact_id, fact_type, source_domain, language, doc_id FROM l")
def q_facts_latest(t: Tables) -> DataFrame:
    return _latest(t).select("fact_id", "fact_type", "source_domain", "language", "doc_id")


@query(_LATEST + "SELECT fact_type, count(*) AS n FROM l GROUP BY 1")
def q_fact_counts(t: Tables) -> DataFrame:
    return _latest(t).groupBy("fact_type").agg(F.count(F.lit(1)).alias("n"))


@query(_LATEST + "SELECT source_domain, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, source_domain LIMIT 15")
def q_fact_domains_top15(t: Tables) -> DataFrame:
    return _latest(t).groupBy("source_domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source_domain").limit(15)


@query(_F + "x AS (SELECT 1) SELECT count(*) AS n, count(nullif(source_url, '')) AS with_url, count(raw_snippet) AS with_snippet, count(extracted_at) AS with_time FROM f")
def q_fact_provenance(t: Tables) -> DataFrame:
    return t.sql(FACTS).agg(F.count(F.lit(1)).alias("n"), F.count(F.nullif("source_url", F.lit(""))).alias("with_url"), F.count("raw_snippet").alias("with_snippet"), F.count("extracted_at").alias("with_time"))


@query(_F + "x AS (SELECT 1) SELECT substr(extracted_at, 1, 10) AS partition_date, fact_type, count(*) AS n FROM f GROUP BY 1, 2")
def q_fact_partitions(t: Tables) -> DataFrame:
    return t.sql(FACTS).groupBy(F.substring("extracted_at", 1, 10).alias("partition_date"), "fact_type").agg(F.count(F.lit(1)).alias("n"))


_REASON = """CASE WHEN coalesce(source_url, '') = '' THEN 'missing:source_url' WHEN coalesce(extracted_at, '') = '' THEN 'missing:extracted_at'
 WHEN coalesce(raw_snippet, '') = '' THEN 'missing:raw_snippet' WHEN coalesce(content, '') = '' THEN 'missing:content'
 WHEN NOT starts_with(source_url, 'http') THEN 'bad:source_url' WHEN NOT regexp_full_match(extracted_at, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z?') THEN 'bad:extracted_at' END"""


@query(_F + f"x AS (SELECT 1) SELECT {_REASON} AS reason, count(*) AS n FROM f GROUP BY 1 HAVING reason IS NOT NULL")
def q_fact_gate(t: Tables) -> DataFrame:
    return facts.rejections(t.sql(FACTS))


@query(_F + f"g AS (SELECT {_REASON} AS reason FROM f) SELECT count(*) - count(reason) AS accepted, count(reason) AS rejected, (count(*) - count(reason))::DOUBLE / count(*) AS rate FROM g")
def q_provenance_rate(t: Tables) -> DataFrame:
    return facts.provenance(t.sql(FACTS))


_NORMAL = f"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^[^?#]*') AS bare, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS qs FROM pages),
 h AS (SELECT page_id, qs, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '//([^/]*)', 1)), '^www\\.', ''), ':443$', ''), ':80$', '') AS host, regexp_replace(bare, '^[^/]*//[^/]*', '') AS path FROM u),
 k AS (SELECT page_id, host, CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END AS path,
  list_sort([x FOR x IN string_split(qs, '&') IF regexp_matches(x, '^[^=]*=.') AND NOT split_part(x, '=', 1) IN ({", ".join("'" + x + "'" for x in text.TRACKING_NAMES)}) AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^({"|".join(text.TRACKING_PREFIXES)})')]) AS kept FROM h),
 n AS (SELECT page_id, host AS domain, 'https://' || host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS normal FROM k) """


@query(_NORMAL + "SELECT page_id, domain, normal, sha256(normal) AS url_hash FROM n")
def q_url_normalize(t: Tables) -> DataFrame:
    rows = t("pages").select("page_id", text.url_normal(F.col("url")).alias("normal"))
    return rows.select("page_id", text.url_host(F.col("normal")).alias("domain"), "normal", text.url_hash(F.col("normal")).alias("url_hash"))


@query(_NORMAL + ", s AS (SELECT DISTINCT normal FROM n JOIN pages USING (page_id) WHERE url LIKE '%utm_%') SELECT min(page_id) AS page_id, normal FROM n WHERE normal NOT IN (SELECT normal FROM s) GROUP BY normal")
def q_url_hash_dedupe(t: Tables) -> DataFrame:
    rows = t("pages").select("page_id", "url", text.url_normal(F.col("url")).alias("normal"))
    return crawl.unseen(rows, rows.where("url LIKE '%utm_%'"), "normal", "page_id").select("page_id", "normal")


# one path for each rule and for none, so that all rules fire
_PATHS = (
    "/xg", "/x/ppda", "/a-heatmap", "/estadisticas/laliga", "/partidos/1", "/tips/premier-league", "/odds", "/elo", "/valuebet", "/live", "/h2h", "/standings", "/fichajes", "/contrato",
    "/tactica", "/scouting", "/opinion", "/forum", "/noticias/serie-a", "/lineup", "/2024/05/06/copa-america", "/nothing",
)
_PATH = "CASE page_id % 22 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PATHS)) + " END"
_CLASSES = f"""WITH u AS (SELECT page_id, lower('https://' || regexp_extract(url, '//([^/?#]*)', 1) || {_PATH}) AS low FROM pages),
 g AS (SELECT page_id, low, replace(regexp_extract(low, '{text.URL_LEAGUE}', 1), '-', '') AS league FROM u),
 c AS (SELECT page_id, low, league, CASE {" ".join(f"WHEN regexp_matches(low, '{p}') THEN ['{c}', '{s}']" for p, c, s in text.URL_RULES)} ELSE ['noticias', 'sin_clasificar'] END AS x FROM g) """


def _url_with_path(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.concat(F.lit("https://"), text.url_host(F.col("url")), F.expr(_PATH)).alias("u"))


@query(_CLASSES + "SELECT page_id, x[1] AS category, CASE WHEN league <> '' AND x[2] IN ('general', 'portada_general', 'articulo_fechado') THEN x[2] || ':' || league ELSE x[2] END AS subcategory FROM c")
def q_url_classify(t: Tables) -> DataFrame:
    return _url_with_path(t).select("page_id", text.url_class(F.col("u")).alias("c")).select("page_id", "c.*")


def _alternatives(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


@query(_CLASSES + f"SELECT page_id, NOT regexp_matches(low, '{_alternatives(text.URL_OFF_TOPIC)}') AND regexp_matches(low, '{_alternatives(text.URL_ON_TOPIC)}') AS on_topic FROM c")
def q_url_relevant(t: Tables) -> DataFrame:
    return _url_with_path(t).select("page_id", text.url_on_topic(F.col("u")).alias("on_topic"))


@query("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS seen FROM documents)
 SELECT doc_id, source FROM r ORDER BY turn, seen, doc_id LIMIT 120""")
def q_stratified_sample(t: Tables) -> DataFrame:
    return crawl.round_robin(t("documents").select("doc_id", "source"), 120, "doc_id", "source")


@query("WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) SELECT doc_id, source FROM r WHERE rn <= 20 ORDER BY doc_id LIMIT 300")
def q_domain_cap(t: Tables) -> DataFrame:
    return crawl.domain_caps(t("documents").select("doc_id", "source"), 20, 300, "doc_id", "source")


@query("""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \\t\\x{00a0}]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM documents)
 SELECT doc_id, length(body) AS n_chars, CASE WHEN length(body) > 1200 THEN substr(body, 1, 1199) || '…' ELSE body END AS snippet FROM c""")
def q_snippet_clean(t: Tables) -> DataFrame:
    rows = t("documents").select("doc_id", text.clean_text(F.col("text")).alias("body"))
    return longs(rows.select("doc_id", F.length("body").alias("n_chars"), text.snippet(F.col("body")).alias("snippet")), "n_chars")


@query("SELECT page_id, CASE WHEN length(html) % 5 > 2 THEN 'ok' WHEN regexp_matches(html, '(?i)<(p|article)[\\s>]') THEN 'texto_insuficiente' ELSE 'js_rendered' END AS state FROM pages")
def q_render_class(t: Tables) -> DataFrame:
    enough = F.when(F.length("html") % 5 > 2, facts.TEXT_LEAST).otherwise(0)
    return t("pages").select("page_id", facts.extraction_state(F.col("html"), enough).alias("state"))


@query("""WITH x AS (SELECT page_id, regexp_extract(url, '//([^/?#]*)', 1) AS host, CASE WHEN page_id % 4 = 0 THEN NULL ELSE page_id END AS body, page_id % 7 AS etag FROM pages),
 r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS rn, last_value(body IGNORE NULLS) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS known FROM x)
 SELECT host, etag, known AS body FROM r WHERE rn = 1""")
def q_cache_upsert(t: Tables) -> DataFrame:
    rows = t("pages").select("page_id", text.url_host(F.col("url")).alias("host"), F.when(F.col("page_id") % 4 != 0, F.col("page_id")).alias("body"), (F.col("page_id") % 7).alias("etag"))
    return crawl.cache_state(rows, "host", "page_id", ("etag",), ("body",))


@query()
def q_page_text(t: Tables) -> DataFrame:
    return pages.bounded(t("pages")).select("page_id", pages.text_of("html").alias("t")).select("page_id", "t.*")


@query()
def q_page_facts(t: Tables) -> DataFrame:
    rows = pages.bounded(t("pages")).select("url", "html", pages.text_of("html").alias("t"))
    return facts.text_facts(rows, F.col("t.text"), F.lit("2024-01-01T00:00:00Z")).drop("n_chars")


@query("""WITH n AS (SELECT c_custkey AS id, c_name || CASE c_custkey % 5 WHEN 0 THEN ' FC' WHEN 1 THEN ' & Córdoba' WHEN 2 THEN ' Atlético' WHEN 3 THEN '. São' ELSE ' CD' END AS name FROM customer),
 a AS (SELECT id, trim(regexp_replace(regexp_replace(replace(strip_accents(lower(trim(name))), '&', ' and '), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')) AS x FROM n),
 b AS (SELECT id, x, array_to_string([p FOR p IN string_split(x, ' ') IF p NOT IN ('fc', 'cf', 'sc', 'ac', 'cd', 'ud', 'sd', 'afc', 'cfc', 'ss', 'as', 'us')], ' ') AS y FROM a)
 SELECT id, replace(CASE WHEN y <> '' THEN y ELSE x END, ' ', '_') AS slug FROM b""")
def q_slug(t: Tables) -> DataFrame:
    tail = F.expr("CASE c_custkey % 5 WHEN 0 THEN ' FC' WHEN 1 THEN ' & Córdoba' WHEN 2 THEN ' Atlético' WHEN 3 THEN '. São' ELSE ' CD' END")
    return t("customer").select(F.col("c_custkey").alias("id"), text.team_slug(F.concat("c_name", tail)).alias("slug"))
