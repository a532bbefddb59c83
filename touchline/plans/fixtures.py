"""Relations derived from the synthetic tables, in SQL that Spark and DuckDB both run.

{orders} and the like stand for base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.session import spread

MATCH = """SELECT o_orderkey AS match_id, o_orderkey % 4 AS league, CAST(year(o_orderdate) AS INT) AS season, o_orderdate AS kickoff,
 (o_orderkey % 4) * 12 + o_custkey % 12 AS home,
 (o_orderkey % 4) * 12 + (o_custkey % 12 + 1 + CAST(floor(o_orderkey / 4e0) AS BIGINT) % 11) % 12 AS away,
 CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 AS INT) AS home_goals, CAST(CAST(floor(o_totalprice / 7e0) AS BIGINT) % 4 AS INT) AS away_goals,
 CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 % 3 AS INT) AS home_goals_ht, CAST(CAST(floor(o_totalprice / 7e0) AS BIGINT) % 4 % 2 AS INT) AS away_goals_ht,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice / 3e0) AS BIGINT) % 9 AS INT) END AS home_shots,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice / 11e0) AS BIGINT) % 8 AS INT) END AS away_shots
 FROM {orders}"""
#: Matches of which some are not played.
PARTLY = MATCH.replace("CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 AS INT) AS home_goals", "CASE WHEN o_orderkey % 17 = 3 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 5 AS INT) END AS home_goals")
LOG = f"""SELECT match_id, league, kickoff, home AS team, 1 AS at_home, home_goals AS gf, away_goals AS ga, home_shots AS sf FROM ({MATCH}) m
 UNION ALL SELECT match_id, league, kickoff, away, 0, away_goals, home_goals, away_shots FROM ({MATCH}) m2"""
ODDS = """SELECT o_orderkey AS match_id, CASE WHEN o_custkey % 3 = 0 THEN 'pinnacle' WHEN o_custkey % 3 = 1 THEN 'bet365' ELSE 'media' END AS book,
 1.4e0 + (o_orderkey % 23) / 1e1 AS odds_1, CASE WHEN o_orderkey % 29 = 5 THEN NULL ELSE 2.8e0 + (o_orderkey % 11) / 1e1 END AS odds_x, 1.6e0 + (o_custkey % 29) / 1e1 AS odds_2 FROM {orders}"""
#: Forecasts p and the market's q of each match, its odds and outcome y (0, 1, 2).
PRED = f"""SELECT match_id, league, season, kickoff, a / (a + b + c) AS p1, b / (a + b + c) AS px, c / (a + b + c) AS p2, d / (d + e + f) AS q1, e / (d + e + f) AS qx, f / (d + e + f) AS q2,
 CASE WHEN home_goals > away_goals THEN 0 WHEN home_goals = away_goals THEN 1 ELSE 2 END AS y, odds_1, odds_x, odds_2 FROM (
 SELECT m.*, 1e0 + m.match_id % 7 AS a, 1e0 + CAST(floor(m.match_id / 3e0) AS BIGINT) % 5 AS b, 1e0 + CAST(floor(m.match_id / 5e0) AS BIGINT) % 6 AS c,
 2e0 + m.match_id % 5 AS d, 2e0 + CAST(floor(m.match_id / 7e0) AS BIGINT) % 3 AS e, 2e0 + CAST(floor(m.match_id / 2e0) AS BIGINT) % 4 AS f,
 1.4e0 + (m.match_id % 23) / 1e1 AS odds_1, 2.8e0 + (m.match_id % 11) / 1e1 AS odds_x, 1.6e0 + (m.match_id % 13) / 1e1 AS odds_2 FROM ({MATCH}) m) x"""
SNAPSHOT = """SELECT user_id AS outcome_id, event_type AS market, ts AS captured_at, event_id, CAST(floor(event_id / 3e0) AS BIGINT) AS offer_id, 1.5e0 + floor(abs(value)) % 40 / 1e1 AS odds,
 event_id % 11 = 0 AS is_player FROM {events}"""
FACTS = """SELECT substr(sha256(text), 1, 32) AS fact_id, CASE WHEN doc_id % 3 = 0 THEN 'article_text' WHEN doc_id % 3 = 1 THEN 'table_row' ELSE 'dataset_json' END AS fact_type,
 CASE WHEN doc_id % 41 = 7 THEN '' WHEN doc_id % 43 = 9 THEN 'ftp://x/' || CAST(doc_id AS VARCHAR(20)) ELSE 'https://' || source || '.example.com/' || CAST(doc_id AS VARCHAR(20)) END AS source_url, source AS source_domain,
 CASE WHEN doc_id % 37 = 5 THEN '2024-13' ELSE '2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR(20)), 2, '0') || 'T10:00:00Z' END AS extracted_at, CASE WHEN doc_id % 53 = 1 THEN NULL ELSE substr(text, 1, 40) END AS raw_snippet, text AS content, lang AS language, doc_id
 FROM {documents}"""
_TABLES = ("orders", "events", "documents", "pages", "supplier", "customer", "lineitem", "part")


class Tables:
    """Base tables of a folder by name, and derived relations by their SQL."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, dealt: bool = False) -> DataFrame:
        """sha256(x) is sha2(x, 256) in Spark; the base tables' rows are dealt over all tasks first, if many rows are made of each."""
        text = text.replace("sha256(text)", "sha2(text, 256)")
        return self.spark.sql(text, **{t: spread(self(t)) if dealt else self(t) for t in _TABLES if "{" + t + "}" in text})


def duck(text: str) -> str:
    """The same text over DuckDB's views."""
    for t in _TABLES:
        text = text.replace("{" + t + "}", t)
    return text
