"""Queries over landed files: each writes what a landing job would have left, as made from the given tables, and reads it through the readers.

The files lie in a new folder below the shared one, so that a query that runs twice doesn't meet its own files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import text
from touchline.operators import crawl, entity, facts, feed, matches, scorers, settlement
from touchline.plans.base import longs, query, rounded
from touchline.plans.crawl_queries import _alternatives
from touchline.plans.fixtures import FACTS, MATCH, Tables
from touchline.session import shared_folder
from touchline.sources import dimensions, readers, writers
from touchline.streaming import streams


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"


def _lines(rows: DataFrame, broken: str) -> str:
    """Writes rows as JSON lines, with a broken line after each row for which `broken` holds, and returns the folder."""
    path = _folder(rows.sparkSession)
    line = F.to_json(F.struct(*rows.columns))
    rows.select(F.explode(F.array(line, F.when(F.expr(broken), F.concat(F.lit("{"), line)))).alias("value")).where("value is not null").write.text(path)
    return path


# ---- CSVs of matches

#: Matches as a CSV has them: days with two and four digits of a year, times that are missing or can't be, matches that aren't valid.
_PLAYED = f"""SELECT match_id, league, kickoff, home_goals, away_goals, home_shots, CASE WHEN month(kickoff) >= 7 THEN year(kickoff) ELSE year(kickoff) - 1 END AS began,
 CASE WHEN match_id % 41 = 5 THEN NULL ELSE 'Club ' || CAST(home AS VARCHAR(10)) END AS home_name, 'Club ' || CAST(CASE WHEN match_id % 31 = 3 THEN home ELSE away END AS VARCHAR(10)) AS away_name,
 CASE match_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '25:99' ELSE CAST(10 + match_id % 5 AS VARCHAR(2)) || ':30' END AS hour,
 CASE WHEN match_id % 37 = 4 THEN 'X' WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS letter,
 CASE WHEN match_id % 19 = 6 THEN 'x' ELSE CAST(1 + match_id % 7 AS VARCHAR(10)) || '.5' END AS one, CASE WHEN match_id % 23 = 7 THEN NULL ELSE '3.' || CAST(match_id % 10 AS VARCHAR(10)) END AS draw, CAST(2 + match_id % 6 AS VARCHAR(10)) || '.25' AS two
 FROM ({MATCH}) q"""
_AT = "CASE WHEN match_id % 5 < 2 THEN '15:00' ELSE hour END"
_KEY = "substr(sha256('L' || league || '|' || CAST(kickoff AS VARCHAR)[1:10] || '|' || lower(replace(home_name, ' ', '_')) || '|' || lower(replace(away_name, ' ', '_'))), 1, 24)"
#: Parts of a season's CSV of a league.
_CSV_PARTS = 8
_VALID = "home_name IS NOT NULL AND home_name <> away_name AND letter <> 'X'"


def _csv_rows(t: Tables) -> DataFrame:
    """The rows of a CSV for each season and league, below one folder, read again."""
    path, day = _folder(t.spark), F.col("kickoff").cast("date")
    # each season and league is written by a few tasks, and each task writes few files
    rows = t.sql(_PLAYED)
    rows = rows.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "began", "league", F.pmod(F.xxhash64("match_id"), F.lit(_CSV_PARTS)))
    row = rows.select(
        F.concat(F.lpad(F.pmod("began", F.lit(100)), 2, "0"), F.lpad(F.pmod(F.col("began") + 1, F.lit(100)), 2, "0")).alias("folder"), F.concat(F.lit("L"), "league", F.lit(".csv")).alias("file"),
        F.when(F.col("match_id") % 2 == 0, F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd/MM/yy")).alias("Date"), F.col("hour").alias("Time"), F.col("home_name").alias("HomeTeam"), F.col("away_name").alias("AwayTeam"),
        F.col("home_goals").alias("FTHG"), F.col("away_goals").alias("FTAG"), F.col("letter").alias("FTR"), F.col("home_shots").alias("HST"), F.col("one").alias("PSCH"), F.col("draw").alias("PSCD"), F.col("two").alias("PSCA"),
        F.col("one").alias("PC>2.5"), F.col("two").alias("PC<2.5"),
    )
    row.write.partitionBy("folder", "file").option("header", True).csv(path)
    _named(t.spark, path)
    return readers.csv_rows(t.spark, f"{path}/*/*.csv")


def _named(spark: SparkSession, path: str) -> None:
    """Names folder=9495/file=L0.csv below a path 9495/L0.csv, as a landing job does: a rename for each season and league."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for season in files.globStatus(hadoop(f"{path}/folder=*")):
        place = f"{path}/{season.getPath().getName().partition('=')[2]}"
        files.rename(season.getPath(), hadoop(place))
        for file in files.globStatus(hadoop(f"{place}/file=*")):
            files.rename(file.getPath(), hadoop(f"{place}/{file.getPath().getName().partition('=')[2]}"))


@query(f"""WITH m AS ({_PLAYED}) SELECT {_KEY} AS match_id, 'L' || league AS league, began || '-' || lpad(((began + 1) % 100)::VARCHAR, 2, '0') AS season, CAST(kickoff AS VARCHAR)[1:10] || 'T' || {_AT} || ':00Z' AS kickoff,
 lower(replace(home_name, ' ', '_')) AS home, lower(replace(away_name, ' ', '_')) AS away, home_goals, away_goals, home_shots FROM m WHERE {_VALID}""")
def q_csv_matches(t: Tables) -> DataFrame:
    return readers.matches_from_csv(_csv_rows(t)).select("match_id", "league", "season", "kickoff", "home", "away", "home_goals", "away_goals", "home_shots")


@query(f"""WITH m AS (SELECT {_KEY} AS match_id, TRY_CAST(one AS DOUBLE) AS a, TRY_CAST(draw AS DOUBLE) AS b, TRY_CAST(two AS DOUBLE) AS c FROM ({_PLAYED}) x WHERE home_name IS NOT NULL)
 SELECT match_id, 'pinnacle' AS book, '1x2' AS market, a AS odds_1, b AS odds_x, c AS odds_2, NULL::DOUBLE AS line FROM m WHERE a IS NOT NULL AND b IS NOT NULL
 UNION ALL SELECT match_id, 'pinnacle', 'ou25', a, NULL, c, 2.5 FROM m WHERE a IS NOT NULL""")
def q_csv_odds(t: Tables) -> DataFrame:
    return readers.odds_from_csv(_csv_rows(t)).select("match_id", "book", "market", "odds_1", "odds_x", "odds_2", "line")


# ---- JSON lines, ledgers, tables by partition

_HOST = "regexp_extract(url, '//([^/?#]*)', 1)"


@query(f"SELECT page_id::VARCHAR AS id, url, {_HOST} AS domain FROM pages WHERE contains({_HOST}, 'example.org') OR contains({_HOST}, 'blog.')")
def q_url_lines(t: Tables) -> DataFrame:
    rows = t("pages").select(F.col("page_id").cast("string").alias("id"), "url", F.regexp_extract("url", "//([^/?#]*)", 1).alias("domain"))
    return readers.crawled_urls(t.spark, _lines(rows, "length(id) % 2 = 0"), ["example.org", "blog."]).select("id", "url", "domain")


_TICKET = "SELECT o_orderkey AS id, 't' || CAST(o_orderkey AS VARCHAR(20)) AS ticket_id, 1e0 + o_custkey % 5 AS stake, 2e0 + o_orderkey % 9 AS odds, CASE WHEN o_orderkey % 3 = 0 THEN 'pendiente' ELSE 'liquidado' END AS state FROM {orders}"


def _tickets(t: Tables) -> str:
    leg = F.struct(F.col("id").alias("event_id"), F.col("odds"))
    return _lines(t.sql(_TICKET).withColumn("legs", F.array(leg, leg)).drop("id"), "state = 'pendiente'")


@query(f"WITH t AS ({_TICKET}) SELECT state, count(*) AS n, sum(stake) AS staked, 2 * count(*) AS n_legs FROM t GROUP BY 1 UNION ALL SELECT 'unreadable', count(*), NULL, NULL FROM t WHERE state = 'pendiente'")
def q_ledger_lines(t: Tables) -> DataFrame:
    tickets, unreadable = readers.ledger(t.spark, _tickets(t))
    found = tickets.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("stake").alias("staked"), F.sum(F.size("legs")).cast("long").alias("n_legs"))
    none = unreadable.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unreadable").alias("state"), "n", F.lit(None).cast("double").alias("staked"), F.lit(None).cast("long").alias("n_legs"))
    return found.unionByName(none)


@query(f"WITH t AS ({_TICKET}) SELECT ticket_id, CASE WHEN id % 6 = 0 THEN 'liquidado' ELSE state END AS state, CASE WHEN id % 6 = 0 THEN stake * odds END AS payout FROM t")
def q_ledger_replaced(t: Tables) -> DataFrame:
    """A ledger whose table is read, settled in part and put in its own place."""
    tickets, _ = readers.ledger(t.spark, _tickets(t))
    table = _folder(t.spark)
    writers.replace_table(tickets, table)
    won = (F.col("state") == "pendiente") & (F.substring("ticket_id", 2, 20).cast("long") % 6 == 0)
    now = t.spark.read.schema(readers.LEDGER).json(table)
    writers.replace_table(now.withColumns({"payout": F.when(won, F.col("stake") * F.col("odds")), "state": F.when(won, "liquidado").otherwise(F.col("state"))}), table)
    return t.spark.read.schema(readers.LEDGER).json(table).select("ticket_id", "state", "payout")


_SEASON = f"SELECT match_id, season, home_goals FROM ({MATCH}) q"


@query(f"WITH m AS ({_SEASON}) SELECT season, count(*) AS n, sum(home_goals)::BIGINT AS goals FROM (SELECT season, home_goals FROM m WHERE season % 2 = 0 UNION ALL SELECT season, 10 * home_goals FROM m WHERE season % 2 = 1 AND match_id % 2 = 0) x GROUP BY 1")
def q_seasons_overwritten(t: Tables) -> DataFrame:
    """A table by season, of which odd seasons are written anew; the others stay."""
    table, rows = _folder(t.spark), t.sql(_SEASON)
    writers.overwrite_partitions(rows, table, "season")
    writers.overwrite_partitions(rows.where("season % 2 = 1 and match_id % 2 = 0").withColumn("home_goals", 10 * F.col("home_goals")), table, "season")
    return readers.partitioned(t.spark, table).groupBy(F.col("season").cast("int").alias("season")).agg(F.count(F.lit(1)).alias("n"), F.sum("home_goals").alias("goals"))


_CAPTURES = "SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day FROM events"


@query(f"WITH c AS ({_CAPTURES}) SELECT event_id, user_id, day FROM c WHERE day = (SELECT max(day) FROM c) UNION ALL SELECT event_id, user_id, day FROM c WHERE day = (SELECT max(day) FROM c) AND user_id % 2 = 0")
def q_latest_partition(t: Tables) -> DataFrame:
    """Two captures that are appended by day, and the last day of both."""
    table, rows = _folder(t.spark), t("events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    writers.append(rows, table, "day")
    writers.append(rows.where("user_id % 2 = 0"), table, "day")
    return readers.partitioned(t.spark, table, "event_id long, user_id long, day string", latest_by="day")


@query(f"SELECT * FROM ({_CAPTURES}) q")
def q_lines_by_size(t: Tables) -> DataFrame:
    """JSON lines in files of a bounded number of rows, and all of them again."""
    path = _folder(t.spark)
    writers.json_lines(t("events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")), path, per_file=20_000)
    return readers.json_lines(t.spark, path, "event_id long, user_id long, day string")


@query(f"WITH m AS ({_SEASON}) SELECT count(*) AS n, sum(home_goals)::BIGINT AS goals, max(season) AS last FROM m")
def q_run_report(t: Tables) -> DataFrame:
    """A run's report as a JSON file."""
    path = f"{_folder(t.spark)}.json"
    writers.report(t.sql(_SEASON).agg(F.count(F.lit(1)).alias("n"), F.sum("home_goals").alias("goals"), F.max("season").alias("last")), path)
    return t.spark.read.schema("n long, goals long, last int").json(path)


@query(f"WITH f AS ({FACTS}), r AS (SELECT * FROM f UNION ALL SELECT fact_id, fact_type, source_url, source_domain, '2025-' || extracted_at[6:], raw_snippet, content, language, doc_id FROM f WHERE doc_id % 4 = 0) SELECT fact_id, max(extracted_at) AS extracted_at FROM r GROUP BY 1")
def q_facts_view(t: Tables) -> DataFrame:
    """Facts in a table by day, in which some have been extracted twice, through the view of the latest ones."""
    table = _folder(t.spark)
    rows = t.sql(FACTS)
    again = rows.where("doc_id % 4 = 0").withColumn("extracted_at", F.concat(F.lit("2025-"), F.substring("extracted_at", 6, 30)))
    for part in (rows, again):
        writers.append(part.drop("doc_id").withColumn("partition_date", F.substring("extracted_at", 1, 10)), table, "partition_date")
    readers.facts_views(t.spark, table)
    return t.spark.sql("SELECT fact_id, extracted_at FROM facts")


# ---- documents of a feed

_EVENT = "SELECT s_suppkey AS id, s_nationkey AS nation, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'Home ' || CAST(s_suppkey AS VARCHAR(20)) END AS home, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'Cup ' || CAST(s_nationkey AS VARCHAR(20)) END AS cup FROM {supplier}"


@query(f"""SELECT id AS event_id, coalesce(home, 'A' || id) AS home_name, 'B' || id AS away_name, CASE WHEN id % 5 = 0 THEN 'Sport' ELSE 'Football' END AS sport, 'Country ' || nation AS country,
 CASE WHEN cup = '' THEN 'League ' || nation ELSE cup END AS league, 'league_' || nation AS league_key FROM ({_EVENT}) e""")
def q_feed_events(t: Tables) -> DataFrame:
    node = lambda kind, name, english, key: F.struct(F.lit(kind).cast("long").alias("id"), name.alias("name"), english.alias("englishName"), key.alias("termKey"))
    nation, sport = F.col("nation").cast("string"), F.col("id") % 5 == 0
    path = F.array(
        node(1, F.lit("Deporte"), F.when(sport, "Sport").otherwise("Football"), F.when(sport, "sport").otherwise("football")),
        node(2, F.concat(F.lit("Country "), nation), F.lit("Country"), F.lit("country")), node(3, F.concat(F.lit("League "), nation), F.lit("League"), F.concat(F.lit("league_"), nation)),
    )
    event = t.sql(_EVENT).select("id", F.concat(F.lit("A"), "id", F.lit(" - B"), "id").alias("name"), F.lit("2024-08-16T20:00:00Z").alias("start"), F.col("cup").alias("group"), F.col("home").alias("homeName"), path.alias("path"))
    return readers.feed_events(t.spark, _lines(event, "false"), "2024-08-15T00:00:00Z").select("event_id", "home_name", "away_name", "sport", "country", "league", "league_key")


_LEAGUES = "SELECT n.n_name AS country, s.s_suppkey % 3 AS k, count(*) AS events FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey GROUP BY 1, 2"
_TREE = "name string, groups array<struct<name:string,groups:array<struct<name:string,termKey:string,eventCount:long>>>>"


def _tree(t: Tables) -> DataFrame:
    """The feed's tree of countries and leagues, landed as one document."""
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name", (F.col("s_suppkey") % 3).alias("k")).agg(F.count(F.lit(1)).alias("eventCount"))
    league = F.struct(F.concat(F.lit("League "), "k").alias("name"), F.concat(F.lit("league_"), "k").alias("termKey"), "eventCount")
    countries = rows.groupBy(F.col("n_name").alias("name")).agg(F.collect_list(league).alias("groups"))
    tree = countries.agg(F.collect_list(F.struct("name", "groups")).alias("groups")).select(F.lit("Football").alias("name"), "groups")
    return t.spark.read.schema(_TREE).json(_lines(tree, "false"))


@query(f"SELECT country, 'League ' || k AS league, 'league_' || k AS league_key, events FROM ({_LEAGUES}) q WHERE events >= 2")
def q_league_tree(t: Tables) -> DataFrame:
    return feed.leagues_with_events(_tree(t), 2)


def _wanted(t: Tables) -> DataFrame:
    return t("nation").select(F.col("n_name").alias("country"), F.explode(F.array(F.lit("league_0"), F.lit("league_9"))).alias("league_key"))


@query(f"SELECT country, 'league_' || k AS league_key, events FROM ({_LEAGUES}) q WHERE k = 0")
def q_leagues_selected(t: Tables) -> DataFrame:
    return feed.selected_leagues(feed.leagues_with_events(_tree(t)), _wanted(t)).select("country", "league_key", "events")


@query(f"SELECT n_name AS country, x AS league_key FROM nation, (VALUES ('league_0'), ('league_9')) v(x) WHERE x = 'league_9' OR n_name NOT IN (SELECT country FROM ({_LEAGUES}) q WHERE k = 0)")
def q_leagues_missing(t: Tables) -> DataFrame:
    return feed.missing_leagues(_wanted(t), feed.leagues_with_events(_tree(t)))


@query("""WITH e AS (SELECT event_id, ts AS start, user_id % 7 AS league FROM events UNION ALL SELECT event_id, ts, user_id % 7 + 1 FROM events WHERE event_id % 3 = 0)
 SELECT event_id, min(league) AS league FROM e GROUP BY event_id, start ORDER BY start, event_id LIMIT 200""")
def q_first_events(t: Tables) -> DataFrame:
    rows = t("events").select("event_id", F.col("ts").alias("start"), (F.col("user_id") % 7).alias("league"))
    again = rows.where("event_id % 3 = 0").withColumn("league", F.col("league") + 1)
    return feed.first_events(rows.unionByName(again), 200).select("event_id", "league")


_GOALS = "SELECT c_custkey AS id, c_nationkey AS nation, CASE WHEN c_custkey % 11 = 4 THEN NULL ELSE c_name END AS player, CASE WHEN c_custkey % 7 = 2 THEN NULL ELSE CAST(c_custkey % 20 AS INT) END AS goals, CAST(5 + c_custkey % 30 AS INT) AS played FROM {customer}"


@query(f"SELECT coalesce(player, '?') AS player, 'Team ' || nation AS team, coalesce(goals, 0) AS goals, played FROM ({_GOALS}) q")
def q_scorers_payload(t: Tables) -> DataFrame:
    one = F.struct(F.struct(F.col("player").alias("name")).alias("player"), F.struct(F.concat(F.lit("Team "), "nation").alias("name")).alias("team"), "goals", F.col("played").alias("playedMatches"))
    payload = t.sql(_GOALS).groupBy("nation", F.floor(F.col("id") / 500)).agg(F.collect_list(one).alias("scorers")).select("scorers")
    return scorers.scorers_from_payload(readers.json_lines(t.spark, _lines(payload, "size(scorers) > 1"), readers.SCORERS))


@query("SELECT CASE s_suppkey % 3 WHEN 0 THEN 'Inglaterra' WHEN 1 THEN 'Brasil' ELSE 'Chile' END AS country, CASE s_suppkey % 3 WHEN 0 THEN 'premier_league' WHEN 1 THEN 'serie_b' ELSE 'primera' END AS league_key, count(*) AS n, s_suppkey % 3 = 0 AS covered FROM supplier GROUP BY s_suppkey % 3")
def q_scorers_covered(t: Tables) -> DataFrame:
    pick = lambda *v: F.get(F.array(*map(F.lit, v)), F.col("s_suppkey") % 3)
    events = t("supplier").select(pick("Inglaterra", "Brasil", "Chile").alias("country"), pick("premier_league", "serie_b", "primera").alias("league_key"))
    return scorers.covered(events, dimensions.scorer_leagues(t.spark))


@query(f"SELECT match_id AS event_id, home_goals, away_goals, CASE WHEN match_id % 4 > 0 THEN home_goals_ht END AS home_goals_ht, CASE WHEN match_id % 4 > 0 THEN away_goals_ht END AS away_goals_ht FROM ({MATCH}) q WHERE match_id % 6 > 0 AND match_id % 13 > 0")
def q_results_payload(t: Tables) -> DataFrame:
    score = F.struct(
        F.struct(F.col("home_goals").alias("home"), F.when(F.col("match_id") % 13 > 0, F.col("away_goals")).alias("away")).alias("fullTime"),
        F.when(F.col("match_id") % 4 > 0, F.struct(F.col("home_goals_ht").alias("home"), F.col("away_goals_ht").alias("away"))).alias("halfTime"),
    )
    rows = t.sql(MATCH).select(F.col("match_id").alias("event_id"), F.when(F.col("match_id") % 6 > 0, "FINISHED").otherwise("IN_PLAY").alias("status"), score.alias("score"))
    return settlement.scores_from_results(readers.json_lines(t.spark, _lines(rows, "event_id % 9 = 1"), readers.RESULTS))


# ---- robots, sitemaps, feeds, indexes, seeds


@query(f"SELECT page_id, 'https://' || {_HOST} || '/s' || page_id || '.xml' AS sitemap FROM pages UNION ALL SELECT page_id, 'https://' || {_HOST} || '/news.xml' FROM pages WHERE page_id % 2 = 0")
def q_robots_sitemaps(t: Tables) -> DataFrame:
    host = F.concat(F.lit("https://"), F.regexp_extract("url", "//([^/?#]*)", 1))
    robots = F.concat(F.lit("User-agent: *\r\nDisallow: /x\n SITEMAP:  "), host, F.lit("/s"), "page_id", F.lit(".xml \r\n"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Sitemap:"), host, F.lit("/news.xml"))).otherwise("# Sitemap none"))
    return crawl.sitemap_links(t("pages").select("page_id", robots.alias("text")))


@query("SELECT DISTINCT url FROM pages WHERE page_id // 50 % 8 <> 7")
def q_sitemap_pages(t: Tables) -> DataFrame:
    """Pages by sitemaps of fifty, which indexes of a hundred name; of eight sitemaps one was never landed."""
    rows = t("pages").select(F.floor(F.col("page_id") / 50).alias("k"), F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("\n</loc></url>")).alias("loc"))
    place = lambda kind, k: F.concat(F.lit(f"https://x/{kind}"), k.cast("string"), F.lit(".xml"))
    maps = rows.groupBy("k").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("loc"), ""), F.lit("</urlset>")).alias("xml"))
    children = maps.select(F.floor(F.col("k") / 100).alias("i"), F.concat(F.lit("<sitemap><loc>"), place("s", F.col("k")), F.lit("</loc></sitemap>")).alias("loc"))
    indexes = children.groupBy("i").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list("loc"), ""), F.lit("</sitemapindex>")).alias("xml")).select(place("i", F.col("i")).alias("url"), "xml")
    landed = maps.where("k % 8 <> 7").select(place("s", F.col("k")).alias("url"), "xml").unionByName(indexes)
    return crawl.expand_sitemaps(indexes.select(F.col("url").alias("sitemap")), landed)


@query("SELECT page_id, url AS link FROM pages WHERE page_id % 3 < 2")
def q_feed_links(t: Tables) -> DataFrame:
    link = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<![CDATA["), "url", F.lit("]]>"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("\n "), "url", F.lit(" "))).otherwise("")
    xml = F.concat(F.lit("<rss><channel><link>https://site</link><item><title>a</title><link>"), link, F.lit("</link></item></channel></rss>"))
    return t("pages").select("page_id", F.explode(crawl.feed_links(xml)).alias("link"))


@query("SELECT DISTINCT url, '2024' || page_id % 12 AS timestamp FROM pages WHERE page_id % 5 > 0 AND page_id % 7 > 0")
def q_index_urls(t: Tables) -> DataFrame:
    rows = t("pages").select("url", F.when(F.col("page_id") % 5 > 0, "200").otherwise("404").alias("status"), F.when(F.col("page_id") % 7 > 0, "text/html; charset=utf-8").otherwise("image/png").alias("mime"), F.concat(F.lit("2024"), (F.col("page_id") % 12).cast("string")).alias("timestamp"))
    return readers.index_urls(t.spark, _lines(rows.union(rows), "status = '404'"))


_SEEDS = ", ".join(str(s) for s in sorted(set(dimensions.SEEDS)))
_SEEDED = f"SELECT p.page_id, s.* FROM pages p JOIN (SELECT *, row_number() OVER (ORDER BY domain) - 1 AS k FROM (VALUES {_SEEDS}) v(domain, language, region, category)) s ON p.page_id % {len(set(dimensions.SEEDS))} = s.k"


_RECORD = f"SELECT page_id, 'https://' || domain || '/' || CASE WHEN page_id % 3 = 0 THEN 'cocina' WHEN page_id % 2 = 0 THEN 'futbol' ELSE 'liga' END || '/z' || page_id AS url, domain, language, region, category, 'sin_clasificar' AS subcategory FROM ({_SEEDED}) q"


_RULES = " ".join(f"WHEN regexp_matches(url, '{p}') THEN ['{c}', '{s}']" for p, c, s in text.URL_RULES)
_SUBS = ", ".join(f"'{s}'" for s in text.URL_LEAGUE_SUBS)


@query(f"""WITH r AS (SELECT *, replace(regexp_extract(url, '{text.URL_LEAGUE}', 1), '-', '') AS of_league, CASE {_RULES} ELSE [category, subcategory] END AS x FROM ({_RECORD}) q
 WHERE regexp_matches(url, '{_alternatives(text.URL_ON_TOPIC)}') AND NOT regexp_matches(url, '{_alternatives(text.URL_OFF_TOPIC)}'))
 SELECT page_id, url, domain, language, region, x[1] AS category, CASE WHEN of_league <> '' AND x[2] IN ({_SUBS}) THEN x[2] || ':' || of_league ELSE x[2] END AS subcategory FROM r""")
def q_seed_records(t: Tables) -> DataFrame:
    known = sorted(set(dimensions.SEEDS))
    domain = F.get(F.array(*(F.lit(s[0]) for s in known)), (F.col("page_id") % len(known)).cast("int"))
    topic = F.when(F.col("page_id") % 3 == 0, "cocina").when(F.col("page_id") % 2 == 0, "futbol").otherwise("liga")
    urls = t("pages").select("page_id", F.concat(F.lit("http://www."), domain, F.lit("/"), topic, F.lit("/z"), "page_id", F.lit("/?utm_source=x")).alias("url"))
    return crawl.records(urls, dimensions.seeds(t.spark).distinct()).select("page_id", "url", "domain", "language", "region", "category", "subcategory")


@query("SELECT v.league, v.country, v.level, count(*) AS n FROM (VALUES " + ", ".join(f"({k}, '{x[0]}', '{x[2]}', {x[3]})" for k, x in enumerate(dimensions.LEAGUES)) + ") v(k, league, country, level) JOIN orders o ON o.o_orderkey % 9 = v.k GROUP BY 1, 2, 3")
def q_league_levels(t: Tables) -> DataFrame:
    code = F.get(F.array(*(F.lit(x[0]) for x in dimensions.LEAGUES)), (F.col("o_orderkey") % 9).cast("int"))
    rows = t("orders").select(code.alias("league")).join(F.broadcast(dimensions.leagues(t.spark)), "league")
    return rows.groupBy("league", "country", "level").agg(F.count(F.lit(1)).alias("n"))


# ---- facts of texts, reports of names, inputs of a model

_BODY = "regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), ''), '[ \\t\\x{00a0}]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"
_ROWS = f"""WITH b AS (SELECT 'https://' || source || '/' || doc_id AS url, {_BODY} AS body FROM documents WHERE doc_id IS NOT NULL), r AS (SELECT 'article_text' AS fact_type, url AS source_url, to_json(struct_pack(text := body, n_chars := length(body)))::VARCHAR AS content,
 CASE WHEN length(body) > 1200 THEN substr(body, 1, 1199) || '…' ELSE body END AS raw_snippet, '2024-01-01T00:00:00Z' AS extracted_at, '2024-01-01' AS partition_date FROM b WHERE length(body) >= {facts.TEXT_LEAST}) """


@query(_ROWS + "SELECT substr(sha256(source_url || '|' || fact_type || '|' || content), 1, 32) AS fact_id, * FROM r")
def q_text_facts(t: Tables) -> DataFrame:
    """Documents as facts: the whole row of each, content as JSON."""
    rows = t("documents").where("doc_id is not null").select(F.concat(F.lit("https://"), "source", F.lit("/"), "doc_id").alias("url"), "text")
    return facts.text_facts(rows, F.col("text"), F.lit("2024-01-01T00:00:00Z")).drop("n_chars")


@query("SELECT source AS bucket, 'total' AS key, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT source, CASE WHEN length(text) >= 200 THEN 'ok' ELSE 'texto_insuficiente' END, count(*) FROM documents WHERE text IS NOT NULL GROUP BY 1, 2")
def q_extraction_counters(t: Tables) -> DataFrame:
    state = F.when(F.length("text") >= facts.TEXT_LEAST, "ok").when(F.col("text").isNotNull(), "texto_insuficiente")
    return facts.counters(t("documents"), F.col("source"), F.lit("total"), state)


@query("""WITH n AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'sin_coincidencia' ELSE 'exacto' END AS method FROM supplier)
 SELECT method, count(*) AS n, CASE WHEN method = 'exacto' THEN count(*) ELSE 0 END AS matched, count(*)::DOUBLE / (SELECT count(*) FROM n) AS share FROM n GROUP BY method""")
def q_name_report(t: Tables) -> DataFrame:
    """Names of which two of three are known as they stand, or but for case, and the others are like none."""
    name = F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 12)
    rows = t("supplier").select(name.alias("slug"), (F.col("s_suppkey") % 97).alias("block"), F.col("s_suppkey").alias("k"))
    names = rows.select(F.when(F.col("k") % 3 == 0, F.substring(F.sha2(F.col("slug"), 256), 1, 20)).when(F.col("k") % 3 == 1, F.upper("slug")).otherwise(F.col("slug")).alias("name"), "block")
    return entity.report(entity.resolve(names, rows.select("slug", "block"), "block", closest=False))


@query("SELECT x AS \"column\" FROM (VALUES ('home_goals'), ('away_goals'), ('home_goals_ht'), ('away_goals_ht'), ('home_shots'), ('away_shots')) v(x)")
def q_model_inputs(t: Tables) -> DataFrame:
    """The columns that a model may see, with their shares of values left out."""
    rows = t.sql(MATCH).withColumns(matches.labels(F.col("home_goals"), F.col("away_goals")))
    return matches.coverage(rows, matches.inputs(rows.columns)).select("column")


# ---- streams over the files of a table


def _streamed(t: Tables, of, name: str, mode: str = "append") -> DataFrame:
    """What a stream over the events' files has written once all are read; in update mode a folder for each batch."""
    base, out = _folder(t.spark), _folder(t.spark)
    t("events").select("event_id", "user_id", "ts", "value").repartitionByRange(8, "ts").sortWithinPartitions("ts").write.parquet(f"{base}/in")
    rows = streams.captures(t.spark, f"{base}/in", "event_id long, user_id long, ts timestamp, value double")
    found = of(rows).writeStream
    sink = found.format("parquet").option("path", out) if mode == "append" else found.foreachBatch(lambda part, k: part.write.mode("overwrite").parquet(f"{out}/batch={k}"))
    running = sink.option("checkpointLocation", f"{base}/state").outputMode(mode).queryName(f"{name}-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    running.awaitTermination()
    return t.spark.read.parquet(out)


@query("SELECT user_id, min(ts) AS first FROM events GROUP BY 1")
def q_stream_first_seen(t: Tables) -> DataFrame:
    """Keys with their earliest row; of those that a later batch corrects the earliest counts."""
    return _streamed(t, lambda rows: streams.earliest(rows, "user_id", "ts"), "first", "update").groupBy("user_id").agg(F.min("ts").alias("first"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, user_id % 5 AS k, count(*) AS n, round(min(value), 6) AS lo, round(max(value), 6) AS hi FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def q_stream_windows(t: Tables) -> DataFrame:
    """Windows of a day that the watermark has closed."""
    found = _streamed(t, lambda rows: streams.windowed(rows.withColumn("k", F.col("user_id") % 5), "ts", "1 day", ["k"], "value"), "windows")
    return rounded(longs(found, "n"), "lo", "hi").select("start", "k", "n", "lo", "hi")
