"""Readers of landed files: match CSVs, JSON lines, partitioned Parquet, feed documents, ledgers, pages.

Fetching over the network is left to a landing job; these readers take what it has written.  Schemas are explicit, so that
a column that is all null keeps its type, and bad lines are dropped or set aside, never fatal."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.odds import decimal_odds, whole
from touchline.functions.text import match_key, season_label, season_start, slugs_key, team_slug
from touchline.operators import feed
from touchline.operators.matches import invalid_reason

# Columns of match CSVs and their names here.
MATCH_COUNTS = {
    "FTHG": "home_goals", "FTAG": "away_goals", "HTHG": "home_goals_ht", "HTAG": "away_goals_ht", "HS": "home_attempts", "AS": "away_attempts",
    "HST": "home_shots", "AST": "away_shots", "HC": "home_corners", "AC": "away_corners", "HF": "home_fouls", "AF": "away_fouls",
    "HY": "home_yellows", "AY": "away_yellows", "HR": "home_reds", "AR": "away_reds",
}
# Prefixes of closing odds by bookmaker.
BOOKS_1X2 = (("B365C", "bet365"), ("PSC", "pinnacle"), ("AvgC", "media_mercado"), ("MaxC", "mejor_disponible"))
BOOKS_TOTAL = (("B365C", "bet365"), ("PC", "pinnacle"), ("AvgC", "media_mercado"), ("MaxC", "mejor_disponible"))
BOOKS_HANDICAP = (("B365C", "bet365"), ("PC", "pinnacle"), ("AvgC", "media_mercado"))

FACTS = "fact_id string, fact_type string, source_url string, source_domain string, content string, raw_snippet string, extracted_at string, fetched_at string, http_status int, published_at string, title string, language string, category string, subcategory string, extractor string, partition_date string"
URLS = "id string, url string, domain string, category string, subcategory string, language string, region string, source_method string, discovered_at string"
LEG = "event_id:bigint,match:string,league:string,start:string,market:string,selection:string,line:double,odds:double,period:string,side:string,outcome_id:bigint,p:double"
LEDGER = f"ticket_id string, issued_at string, odds double, p double, promised_ev double, n_legs int, stake double, state string, payout double, net double, settled_at string, first_start string, last_start string, legs array<struct<{LEG}>>"
RESULTS = "event_id bigint, utcDate string, status string, homeTeam struct<name:string>, awayTeam struct<name:string>, score struct<fullTime:struct<home:int,away:int>,halfTime:struct<home:int,away:int>>"
SCORERS = "competition struct<name:string>, season struct<startDate:string>, scorers array<struct<player:struct<name:string>,team:struct<name:string>,goals:int,playedMatches:int>>"


def match_file(league: str, season: str) -> str:
    """Where a season's CSV of a league lies below the landing folder: 2024-25 and E0 to 2425/E0.csv."""
    first, last = season.split("-")
    return f"{first[2:]}{last[-2:]}/{league}.csv"


def kickoff(day: Column, time: Column) -> Column:
    """dd/MM/yyyy or dd/MM/yy (69 to 99 are of the last century) and HH:mm as ISO text; 15:00 without a usable time; null without a day."""
    short = F.try_to_date(F.trim(day), "dd/MM/yy")
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    date = F.coalesce(F.try_to_date(F.trim(day), "dd/MM/yyyy"), short)
    usable = F.trim(time).rlike(r"^([01]?\d|2[0-3]):[0-5]\d")
    hour = F.when(usable, F.regexp_extract(F.trim(time), r"^(\d{1,2}:\d{2})", 1)).otherwise("15:00")
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T"), F.lpad(hour, 5, "0"), F.lit(":00Z"))


def csv_rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Match CSVs as text columns by their headers, with the league that the path names; a CSV may also be a folder of parts, E0.csv/part-0.csv."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).csv(paths)
    path = F.input_file_name()
    last, above = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    named = lambda c: c.endswith(".csv") & (F.length(c) > 4)
    stem = lambda c: F.left(c, F.length(c) - 4)
    # no regular expression, which would try each place of a long path in each row
    return rows.withColumns({"league": F.when(named(above), stem(above)).when(named(last), stem(last)).otherwise(""), "__file": path})


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once a row: filters and columns built on them read their values instead of repeating their expressions."""
    once = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__x")
    return rows.select("*", once).withColumns({n: F.col(f"__x.{n}") for n in columns}).drop("__x")


def matches_from_csv(rows: DataFrame) -> DataFrame:
    """Canonical valid matches of CSV rows (league and the header's columns); rows without teams or a day drop out."""
    have = set(rows.columns)
    text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    start = kickoff(text("Date"), text("Time"))
    named = computed(rows.where("coalesce(HomeTeam, '') <> '' and coalesce(AwayTeam, '') <> ''"), kickoff=start).where("kickoff is not null")
    named = computed(named, home=team_slug(F.col("HomeTeam")), away=team_slug(F.col("AwayTeam")), day=F.substring("kickoff", 1, 10))
    counts = {n: whole(text(c)) for c, n in MATCH_COUNTS.items()}
    found = computed(
        named, match_id=slugs_key(F.col("league"), F.col("kickoff"), F.col("home"), F.col("away")), season=season_label(season_start(F.to_date("day"))), home_name=F.col("HomeTeam"), away_name=F.col("AwayTeam"),
        result=F.nullif(text("FTR"), F.lit("")), referee=F.nullif(text("Referee"), F.lit("")), **counts,
    ).select("match_id", "league", "season", "kickoff", "home", "away", "home_name", "away_name", "result", *counts, "referee", "day")
    return found.where(invalid_reason().isNull())


def odds_from_csv(rows: DataFrame) -> DataFrame:
    """Closing odds of CSV rows: a row per match, bookmaker and market all of whose odds are there."""
    have = set(rows.columns)
    text = lambda c: F.col(f"`{c}`") if c in have else F.lit(None).cast("string")
    start = kickoff(text("Date"), text("Time"))
    line = lambda v: v.cast("double")

    def quote(book: str, market: str, one: str, x: str | None, two: str, at: Column) -> Column:
        return F.struct(F.lit(book).alias("book"), F.lit(market).alias("market"), decimal_odds(text(one)).alias("odds_1"), (decimal_odds(text(x)) if x else F.lit(None).cast("double")).alias("odds_x"), decimal_odds(text(two)).alias("odds_2"), line(at).alias("line"))

    none = F.lit(None)
    quotes = [quote(b, "1x2", f"{p}H", f"{p}D", f"{p}A", none) for p, b in BOOKS_1X2]
    quotes += [quote(b, "ou25", f"{p}>2.5", None, f"{p}<2.5", F.lit(2.5)) for p, b in BOOKS_TOTAL]
    quotes += [quote(b, "ah", f"{p}AHH", None, f"{p}AHA", text("AHCh").try_cast("double")) for p, b in BOOKS_HANDICAP]
    named = computed(rows.where("coalesce(HomeTeam, '') <> '' and coalesce(AwayTeam, '') <> ''"), kickoff=start).where("kickoff is not null")
    found = named.select(match_key(F.col("league"), F.col("kickoff"), F.col("HomeTeam"), F.col("AwayTeam")).alias("match_id"), "kickoff", F.explode(F.array(*quotes)).alias("q")).select("match_id", "kickoff", "q.*")
    return found.where("odds_1 is not null and odds_2 is not null and (market <> '1x2' or odds_x is not null)")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed ones drop out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def crawled_urls(spark: SparkSession, path: str, domains: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """URL records, of domains that contain one of the given texts, up to a limit."""
    rows = json_lines(spark, path, URLS)
    if domains:
        rows = rows.where(reduce(or_, (F.contains("domain", F.lit(d)) for d in domains)))
    return rows.limit(limit) if limit else rows


def ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The tickets of a ledger, and its unreadable lines."""
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.from_json("value", LEDGER).alias("t"))
    good = F.col("t.ticket_id").isNotNull()
    return lines.where(good).select("t.*"), lines.where(~good).select(F.col("value").alias("line"))


def partitioned(spark: SparkSession, path: str, schema: str | None = None, latest_by: str | None = None) -> DataFrame:
    """A partitioned Parquet table, or its latest capture alone."""
    reader = spark.read.schema(schema) if schema else spark.read
    rows = reader.parquet(path)
    return rows.where(F.col(latest_by) == rows.agg(F.max(latest_by)).first()[0]) if latest_by else rows


def feed_events(spark: SparkSession, path: str, captured_at: str) -> DataFrame:
    return feed.events(spark.read.schema(feed.EVENT).json(path), F.lit(captured_at))


def feed_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(feed.RESPONSE).json(path)


def facts_views(spark: SparkSession, path: str) -> None:
    """facts_raw over the partitioned facts, and facts with the latest row of each fact_id, for spark.sql().

    DuckDB's QUALIFY isn't rewritten: a window in a subquery says the same in Spark SQL."""
    spark.read.schema(FACTS).parquet(path).createOrReplaceTempView("facts_raw")
    spark.sql("""CREATE OR REPLACE TEMP VIEW facts AS SELECT * EXCEPT (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY extracted_at DESC) AS rn FROM facts_raw) WHERE rn = 1""")


def index_urls(spark: SparkSession, path: str) -> DataFrame:
    """URLs of landed crawl-index answers (JSON lines with url, status, mime), of HTML pages that were there."""
    rows = json_lines(spark, path, "url string, status string, mime string, timestamp string")
    return rows.where("status = '200' and mime like 'text/html%'").select("url", "timestamp").distinct()


#: Readers of matches and odds by the name of their source.
PROVIDERS = {"csv": (csv_rows, matches_from_csv, odds_from_csv)}


def provider(name: str):
    """A source's functions: raw rows by path, then matches and odds of them."""
    if name not in PROVIDERS:
        raise ValueError(f"no source {name!r}; there are {sorted(PROVIDERS)}")
    return PROVIDERS[name]
