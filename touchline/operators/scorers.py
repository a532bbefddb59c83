"""Goal scorers: rates shrunk toward last season, chances to score in a match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matches that last season's rate counts for; matches of last season that make a rate; matches in all for a reliable one.
PRIOR, PRIOR_LEAST, RELIABLE = 10.0, 5, 8
MEAN_GOALS = 1.35


def shrunk_rates(now: DataFrame, last: DataFrame, prior: float = PRIOR) -> DataFrame:
    """Both have player, goals, played.  Per player: this season's goals and matches, rate, matches it stands on, reliable.

    A player of last season who hasn't scored yet keeps that rate, if it stands on enough matches."""
    a = now.select("player", F.col("goals").alias("goals"), F.col("played").alias("played"))
    b = last.select("player", F.col("goals").alias("goals_b"), F.col("played").alias("played_b"))
    rows = a.join(b, "player", "full_outer")
    usable = F.coalesce(F.col("played_b") >= PRIOR_LEAST, F.lit(False))
    rate_b = F.when(usable, F.col("goals_b") / F.col("played_b").cast("double"))
    here = F.col("played").isNotNull()
    rows = rows.where(here | usable).withColumns(
        {
            "rate_before": rate_b,
            "rate": F.when(~here, rate_b).when(usable, (F.col("goals") + prior * rate_b) / (F.col("played") + prior)).otherwise(F.coalesce(F.try_divide(F.col("goals").cast("double"), F.col("played").cast("double")), F.lit(0.0))),
            "stands_on": F.when(~here, F.lit(prior)).when(usable, F.col("played") + prior).otherwise(F.col("played").cast("double")),
        }
    )
    played, before = F.coalesce("played", F.lit(0)), F.coalesce("played_b", F.lit(0))
    return rows.select("player", F.coalesce("goals", F.lit(0)).alias("goals"), played.alias("played"), before.alias("played_before"), "rate_before", "rate", "stands_on", (played + before >= RELIABLE).alias("reliable"))


def scoring_chances(rates: DataFrame, matches: DataFrame, mean_goals: float = MEAN_GOALS) -> DataFrame:
    """matches (match_id, player, team_goals: expected goals of the player's team) with the chances of at least 1, 2 and 3 goals;
    players without a reliable rate drop out."""
    rows = matches.join(rates.where("reliable").select("player", "rate"), "player")
    lam = F.greatest(F.col("rate") * F.col("team_goals") / max(mean_goals, 0.1), F.lit(1e-6))
    rows = rows.withColumn("lam", lam)
    none = F.exp(-F.col("lam"))
    one, two = none * F.col("lam"), none * F.col("lam") * F.col("lam") / 2
    return rows.withColumns({"p1": 1 - none, "p2": 1 - none - one, "p3": 1 - none - one - two})


def scorers_from_payload(payload: DataFrame) -> DataFrame:
    """Landed top-scorer payloads (scorers array) as player, team, goals, played."""
    s = payload.select(F.explode("scorers").alias("s"))
    return s.select(F.coalesce("s.player.name", F.lit("?")).alias("player"), F.coalesce("s.team.name", F.lit("?")).alias("team"), F.coalesce("s.goals", F.lit(0)).alias("goals"), F.coalesce("s.playedMatches", F.lit(0)).alias("played"))


def covered(events: DataFrame, leagues: DataFrame) -> DataFrame:
    """Events by (country, league_key) and whether a source of scorers covers it."""
    rows = events.groupBy("country", "league_key").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(leagues.select("country", "league_key", F.lit(True).alias("covered"))), ["country", "league_key"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
