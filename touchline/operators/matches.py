"""Canonical matches: validity, deduplication, halves, labels, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.odds import result_letter


def invalid_reason() -> Column:
    """Why a match (match_id, home, away, kickoff, home_goals, away_goals, result) is turned away; null if it is valid."""
    h, a = F.col("home_goals"), F.col("away_goals")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    when = F.try_to_timestamp(F.substring(F.col("kickoff").cast("string"), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return (
        F.when(empty("match_id"), "no match_id")
        .when(empty("home") | empty("away"), "empty team")
        .when(F.col("home") == F.col("away"), "team against itself")
        .when(when.isNull(), "bad kickoff")
        .when((h < 0) | (a < 0), "negative goals")
        .when((F.col("result") != "") & (F.col("result") != result_letter(h, a)), "result against score")
    )


def deduplicated(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key in the order of ingestion; one row per key and task is shuffled."""
    rest = F.struct(*(c for c in rows.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.max_by(rest, order).alias("__r")).select(*keys, "__r.*").select(*rows.columns)


def first_half(matches: DataFrame) -> DataFrame:
    """Matches with the first half's goals as labels; those without them drop out."""
    return matches.where("home_goals_ht is not null and away_goals_ht is not null").withColumns({"home_goals": F.col("home_goals_ht"), "away_goals": F.col("away_goals_ht")})


def second_half(matches: DataFrame) -> DataFrame:
    """Matches with the second half's goals as labels; those with missing or negative ones drop out."""
    rest = matches.withColumns({"home_goals": F.col("home_goals") - F.col("home_goals_ht"), "away_goals": F.col("away_goals") - F.col("away_goals_ht")})
    return rest.where("home_goals >= 0 and away_goals >= 0")


def labels(home: Column, away: Column) -> dict[str, Column]:
    """What is known after the match."""
    return {
        "y_result": result_letter(home, away),
        "y_total": home + away,
        "y_over25": (home + away > 2.5).cast("int"),
        "y_btts": ((home > 0) & (away > 0)).cast("int"),
        "y_home_score": F.when(home > away, 1.0).when(home == away, 0.5).when(home < away, 0.0),
    }


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of non-null values of each column, in one pass."""
    shares = rows.agg(*(F.try_divide(F.count(c), F.count(F.lit(1))).alias(c) for c in columns))
    return shares.unpivot([], columns, "column", "share")


def worst_covered(rows: DataFrame, columns: list[str], n: int = 6) -> DataFrame:
    """The n columns with the smallest share of non-null values; of equal ones the first by name."""
    return coverage(rows, columns).orderBy("share", "column").limit(n)


def date_range(matches: DataFrame) -> DataFrame:
    """The first and the last kickoff."""
    return matches.agg(F.min("kickoff").alias("first"), F.max("kickoff").alias("last"))


def inputs(columns: list[str], keys: tuple[str, ...] = ("match_id", "league", "season", "kickoff", "day", "home", "away", "feature_version")) -> list[str]:
    """Columns that a model may see: neither keys nor labels."""
    return [c for c in columns if not c.startswith("y_") and c not in keys]


def teams(matches: DataFrame) -> DataFrame:
    return matches.select(F.col("home").alias("team")).union(matches.select("away")).distinct()


def mean_corners(matches: DataFrame, default: float = 10.2, least: int = 30) -> DataFrame:
    """Mean corners of a match; the default with fewer observations."""
    total = F.col("home_corners") + F.col("away_corners")
    return matches.agg(F.when(F.count(total) >= least, F.avg(total)).otherwise(default).alias("mean_corners"))
