"""Queries of reports: ranges, extremes and totals; odds with seasons, results by names that are written in other ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import text
from touchline.operators import crawl, diagnosis, entity, market, matches
from touchline.plans import odds_queries as odds
from touchline.plans.base import query, rounded
from touchline.plans.fixtures import MATCH, ODDS, PARTLY, Tables
from touchline.sources import dimensions

_LATE = f"SELECT * FROM ({MATCH}) m WHERE season >= 1995"


@query(f"SELECT o.match_id, o.book, m.season FROM ({ODDS}) o JOIN ({_LATE}) m ON o.match_id = m.match_id")
def q_odds_season(t: Tables) -> DataFrame:
    return market.with_season(t.sql(ODDS), t.sql(_LATE)).select("match_id", "book", "season")


@query(f"SELECT CAST(min(kickoff) AS VARCHAR)[1:10] AS first, CAST(max(kickoff) AS VARCHAR)[1:10] AS last FROM ({MATCH}) m")
def q_date_range(t: Tables) -> DataFrame:
    found = matches.date_range(t.sql(MATCH))
    return found.select(*(F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first", "last")))


_COLUMNS = ("match_id", "league", "season", "home", "away", "home_goals", "away_goals", "home_shots", "away_shots")


@query(f"WITH m AS ({PARTLY}), c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c})::DOUBLE / count(*) AS share FROM m" for c in _COLUMNS) + ") SELECT \"column\", round(share, 6) AS share FROM c ORDER BY c.share, c.\"column\" LIMIT 6")
def q_worst_covered(t: Tables) -> DataFrame:
    return rounded(matches.worst_covered(t.sql(PARTLY), list(_COLUMNS)), "share")


@query(f"WITH l AS ({odds.LIFT_PAIRS}), t AS (SELECT 'top' AS side, a, b, lift FROM l ORDER BY lift DESC, a, b LIMIT 12), u AS (SELECT 'bottom' AS side, a, b, lift FROM l ORDER BY lift, a, b LIMIT 6) SELECT * FROM t UNION ALL SELECT * FROM u")
def q_extreme_lifts(t: Tables) -> DataFrame:
    return diagnosis.extreme_lifts(odds.q_lift_pairs(t)).select("side", "a", "b", "lift")


@query(f"{odds.COSTS}, t AS (SELECT 'low' AS side, pack_id, ratio FROM c ORDER BY round(ratio, 9), pack_id LIMIT 5), u AS (SELECT 'high' AS side, pack_id, ratio FROM c ORDER BY round(ratio, 9) DESC, pack_id LIMIT 5), both_sides AS (SELECT * FROM t UNION ALL SELECT * FROM u) SELECT side, pack_id, round(ratio, 6) AS ratio FROM both_sides")
def q_extreme_ratios(t: Tables) -> DataFrame:
    return rounded(market.extreme_ratios(odds.costs(t)).select("side", "pack_id", "ratio"), "ratio")


@query("WITH x AS (SELECT regexp_extract(url, '//([^/?#]*)', 1) AS host, max(CASE WHEN page_id % 4 <> 0 THEN page_id END) AS body FROM pages GROUP BY 1) SELECT count(*) AS total, count(body) AS with_body FROM x")
def q_cache_totals(t: Tables) -> DataFrame:
    rows = t("pages").select("page_id", text.url_host(F.col("url")).alias("host"), F.when(F.col("page_id") % 4 != 0, F.col("page_id")).alias("body"))
    return crawl.cache_totals(crawl.cache_state(rows, "host", "page_id", (), ("body",)))


_FEED = "SELECT s_suppkey AS event_id, CASE s_suppkey % 5 WHEN 0 THEN 'España' WHEN 1 THEN 'Países Bajos' WHEN 2 THEN ' INGLATERRA' WHEN 3 THEN 'Perú' ELSE 'Italia' END AS country, CASE s_suppkey % 5 WHEN 0 THEN 'la_liga' WHEN 1 THEN 'eredivisie' WHEN 2 THEN 'premier_league' WHEN 3 THEN 'liga_1' ELSE 'serie_b' END AS league_key FROM {supplier}"


@query("SELECT s_suppkey AS event_id, CASE s_suppkey % 5 WHEN 0 THEN 'SP1' WHEN 1 THEN 'N1' ELSE 'E0' END AS league FROM supplier WHERE s_suppkey % 5 < 3")
def q_feed_league(t: Tables) -> DataFrame:
    return entity.with_league(t.sql(_FEED), dimensions.feed_leagues(t.spark)).select("event_id", "league")


#: Home sides have names unlike one another; results write them in three ways, and are dated up to two days after the event.
_NAME = "substr(md5(CAST(home AS VARCHAR(10))), 1, 12)"
_WRITTEN = f"SELECT match_id AS event_id, CAST(league AS VARCHAR(10)) AS league, CAST(kickoff AS DATE) AS day, {_NAME} AS home_name FROM ({MATCH}) q"
_LANDED = f"SELECT match_id AS result_id, CAST(league AS VARCHAR(10)) AS league, CAST(kickoff AS DATE) + CAST(match_id % 3 AS INT) AS day, CASE home % 3 WHEN 0 THEN 'FC ' || {_NAME} WHEN 1 THEN {_NAME} || ' Real' ELSE upper({_NAME}) END AS home_name, home_goals FROM ({MATCH}) q"


@query(f"""WITH e AS ({_WRITTEN}), r AS ({_LANDED}) SELECT event_id, result_id, home_goals FROM e JOIN r ON e.league = r.league AND r.day BETWEEN e.day AND e.day + 1 AND contains(lower(r.home_name), e.home_name)
 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY r.day, result_id) = 1""")
def q_result_names(t: Tables) -> DataFrame:
    return entity.results_for(t.sql(_WRITTEN), t.sql(_LANDED)).select("event_id", "result_id", "home_goals")


#: Names that compete: two clubs each share their first word, and events write both words, both the other way round, or the first one alone.
_FIRST, _SECOND = "substr(md5(CAST(CAST(floor(home / 2e0) AS BIGINT) AS VARCHAR(10))), 1, 8)", "substr(md5('w' || CAST(home AS VARCHAR(10))), 1, 8)"
_SHORT = f"""SELECT match_id AS event_id, home, match_id % 3 AS form, CAST(league AS VARCHAR(10)) AS league, CAST(kickoff AS DATE) AS day,
 CASE match_id % 3 WHEN 0 THEN {_FIRST} || ' ' || {_SECOND} WHEN 1 THEN {_SECOND} || ' ' || {_FIRST} ELSE {_FIRST} END AS home_name FROM ({MATCH}) q"""
_RIVALS = f"SELECT match_id AS result_id, home, CAST(league AS VARCHAR(10)) AS league, CAST(kickoff AS DATE) + CAST(match_id % 3 AS INT) AS day, {_FIRST} || ' ' || {_SECOND} AS home_name FROM ({MATCH}) q"


@query(f"""WITH e AS ({_SHORT}), r AS ({_RIVALS}),
 m AS (SELECT event_id, result_id, r.home, r.day FROM e JOIN r ON e.league = r.league AND r.day BETWEEN e.day AND e.day + 1 AND (e.home = r.home OR form = 2 AND e.home // 2 = r.home // 2)),
 one AS (SELECT event_id FROM m GROUP BY 1 HAVING count(DISTINCT home) = 1)
 SELECT event_id, result_id FROM m WHERE event_id IN (SELECT event_id FROM one) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY day, result_id) = 1""")
def q_rival_names(t: Tables) -> DataFrame:
    """Results of events whose home sides are written so that rules of equal, reordered and partial names decide; names that fit two clubs stay open."""
    return entity.results_for(t.sql(_SHORT).drop("home", "form"), t.sql(_RIVALS).drop("home")).select("event_id", "result_id")
