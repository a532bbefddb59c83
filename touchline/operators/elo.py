"""Elo ratings of teams before each match.

A match moves two teams' ratings, so no window expresses the recurrence: it is folded in order of (kickoff, match_id) within each group of
teams that play each other, directly or through others (a connected component of the graph of pairings), whatever their leagues, so that a promoted club keeps its
rating.  Time is cut into periods, and ratings are carried from one to the next in a written table by team: a task holds one component's
matches of one period, and a later run goes on from the table that an earlier one has left."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.odds import ELO_HOME, ELO_START, ELO_STEP
from touchline.session import kept


def components(pairs: DataFrame, a: str = "home", b: str = "away") -> DataFrame:
    """Per team (team) the least team that it is connected to (component).

    Each round a team takes the least component among its own and its opponents', and then that component's own, so that chains get short fast."""
    edges = kept(pairs.select(F.col(a).alias("team"), F.col(b).alias("other")).union(pairs.select(b, a)).where("team is not null and other is not null").distinct())
    found = kept(edges.groupBy("team").agg(F.min("other").alias("__o")).select("team", F.least("team", "__o").alias("component")))
    while True:
        near = edges.join(found.select(F.col("team").alias("other"), "component"), "other").groupBy("team").agg(F.min("component").alias("__near"))
        lower = found.join(near, "team").select("team", F.col("component").alias("__was"), F.least("component", "__near").alias("component"))
        root = found.select(F.col("team").alias("component"), F.col("component").alias("__root"))
        lower = kept(lower.join(root, "component", "left").select("team", "__was", F.least("component", F.coalesce("__root", "component")).alias("component")))
        found = lower.select("team", "component")
        if lower.where("component <> __was").isEmpty():
            return found


def run(matches: DataFrame, state: DataFrame | None = None, period: Column | None = None, step: float = ELO_STEP, home_edge: float = ELO_HOME, start: float = ELO_START) -> tuple[DataFrame, DataFrame]:
    """match_id with home_elo, away_elo and the home side's expectation before the match; and the ratings after all of them (team, elo).

    Matches without both teams have no row.  state gives ratings from before; matches must then all be later.  period cuts time (the year of the kickoff if not given) and must never fall as kickoffs rise."""
    team, match = (matches.schema[c].dataType.simpleString() for c in ("home", "match_id"))
    period = F.year("kickoff") if period is None else period
    columns = ["component", "match_id", "kickoff", "home", "away", "home_goals", "away_goals"]
    own = components(matches)
    rows = kept(matches.where("home is not null and away is not null").select("match_id", "kickoff", "home", "away", "home_goals", "away_goals", period.alias("__period")).join(own.withColumnRenamed("team", "home"), "home"))
    state = own.select("team", F.lit(float(start)).alias("elo")).limit(0) if state is None else state
    schema = f"match_id {match}, home_elo double, away_elo double, home_expectation double, team {team}, elo double"

    def fold(games: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        elo = dict(zip(known["team"], known["elo"], strict=True))
        out = []
        for m in games.sort_values(["kickoff", "match_id"]).itertuples(index=False):
            h, a = elo.get(m.home, start), elo.get(m.away, start)
            expected = 1.0 / (1.0 + 10.0 ** (-(h + home_edge - a) / 400.0))
            out.append((m.match_id, h, a, expected, None, None))
            elo.setdefault(m.home, h)
            elo.setdefault(m.away, a)
            if pd.notna(m.home_goals) and pd.notna(m.away_goals):
                score = 1.0 if m.home_goals > m.away_goals else 0.5 if m.home_goals == m.away_goals else 0.0
                move = step * (1.0 + math.log1p(abs(m.home_goals - m.away_goals))) * (score - expected)
                elo[m.home], elo[m.away] = h + move, a - move
        out += [(None, None, None, None, t, e) for t, e in elo.items()]
        found = pd.DataFrame(out, columns=["match_id", "home_elo", "away_elo", "home_expectation", "team", "elo"])
        return found.astype({"match_id": "Int64" if match in ("int", "bigint") else object, "team": "Int64" if team in ("int", "bigint") else object})

    rated = []
    for (cut,) in rows.select("__period").distinct().orderBy("__period").collect():
        games = rows.where(F.col("__period").eqNullSafe(F.lit(cut))).select(columns)
        playing = own.join(games.select(F.col("home").alias("team")).union(games.select("away")).distinct(), "team", "left_semi")
        known = playing.join(state, "team").select(F.col("component").alias("of"), "team", "elo")
        done = kept(games.groupBy("component").cogroup(known.groupBy("of")).applyInPandas(fold, schema))
        rated.append(done.where("match_id is not null").select("match_id", "home_elo", "away_elo", "home_expectation"))
        moved = done.where("match_id is null").select("team", "elo")
        state = kept(state.join(moved, "team", "left_anti").unionByName(moved))
    found = rated[0] if rated else rows.select("match_id", *(F.lit(None).cast("double").alias(c) for c in ("home_elo", "away_elo", "home_expectation")))
    for r in rated[1:]:
        found = found.unionByName(r)
    return found, state


def ratings(matches: DataFrame, **options) -> DataFrame:
    """The ratings of run()."""
    return run(matches, **options)[0]
