"""Point-in-time features of teams from a stream of matches, equal to those of the batch operator.

A team's state is what its features need and no more: the last LONG values of each column, counts and sums by side, and when it last played.  Matches wait in a
list until the watermark has passed their kickoff, so that those which come late, within the allowed delay, take their place in the order of (kickoff,
match_id); a timer at the kickoff wakes the team.  What comes later than that is dropped by the watermark.  Needs the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from touchline.operators import features

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Columns whose last values are kept, and the column whose nulls each follows.
KEPT = {"pts": "pts", "gf": "pts", "ga": "pts", "sf": "sf", "sa": "sa", "xgf": "xgf", "xga": "xga"}
MEANS = {f"{c}_5": (c, features.SHORT) for c in KEPT} | {"gf_10": ("gf", features.LONG), "ga_10": ("ga", features.LONG)}
NAMES = ["prior", "form", *MEANS, "rest_days", "congested", "side_ppm"]


def _row_schema(kind: str) -> str:
    return f"match_id {kind}, at_home int, kickoff_us long, " + ", ".join(f"{c} double" for c in KEPT)


_PAST = "prior long, played_us long, home_n long, home_sum double, away_n long, away_sum double, " + ", ".join(f"{c} array<double>" for c in KEPT)


def known(past: dict, kickoff_us: int, at_home: int) -> dict:
    """The features that a team's past gives a match."""
    mean = lambda v: sum(v) / len(v) if v else None
    weights = [features.DECAY**i for i in range(len(past["pts"]))]
    rest = None if past["played_us"] is None else (kickoff_us - past["played_us"]) / 86_400_000_000.0
    n, total = (past["home_n"], past["home_sum"]) if at_home else (past["away_n"], past["away_sum"])
    found = {"prior": past["prior"], "form": sum(w * v for w, v in zip(weights, past["pts"], strict=True)) / sum(weights) if weights else None}
    found |= {name: mean(past[c][:k]) for name, (c, k) in MEANS.items()}
    return found | {"rest_days": rest, "congested": int(rest is not None and rest < 4), "side_ppm": total / n if n else None}


def learned(past: dict, row: dict) -> dict:
    """The past after a match; an unplayed one teaches nothing."""
    if row["pts"] is None:
        return past
    side = "home" if row["at_home"] else "away"
    after = past | {"prior": past["prior"] + 1, "played_us": row["kickoff_us"], f"{side}_n": past[f"{side}_n"] + 1, f"{side}_sum": past[f"{side}_sum"] + row["pts"]}
    return after | {c: [row[c], *past[c]][: features.LONG] for c, nulls in KEPT.items() if row[nulls] is not None}


EMPTY = {"prior": 0, "played_us": None, "home_n": 0, "home_sum": 0.0, "away_n": 0, "away_sum": 0.0} | {c: [] for c in KEPT}


class TeamFeatures(StatefulProcessor):
    """Holds matches back until the watermark has passed them, then answers and learns in order."""

    def __init__(self, kind: str):
        self.row, self.state = StructType.fromDDL(_row_schema(kind)), StructType.fromDDL(_PAST)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.past = handle.getValueState("past", self.state)
        self.columns = self.row.names

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = []
        for part in rows:
            came += [tuple(None if pd.isna(v) else int(v) if c in ("at_home", "kickoff_us") else float(v) if c in KEPT else v for c, v in zip(self.columns, r, strict=True)) for r in part[self.columns].itertuples(index=False)]
        if came:
            self.waiting.appendList(came)
        for at in {r[2] for r in came}:
            self.handle.registerTimer(at // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [dict(zip(self.columns, r, strict=True)) for r in self.waiting.get()]
        due = sorted((r for r in rows if r["kickoff_us"] <= passed), key=lambda r: (r["kickoff_us"], r["match_id"]))
        if not due:
            return
        left = [tuple(r.values()) for r in rows if r["kickoff_us"] > passed]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        state = self.past.get()
        past = dict(zip(EMPTY, state, strict=True)) if state is not None else EMPTY
        past = past | {c: list(past[c]) for c in KEPT}
        out = []
        for row in due:
            out.append((row["match_id"], key[0], row["at_home"], *(known(past, row["kickoff_us"], row["at_home"])[n] for n in NAMES)))
            past = learned(past, row)
        self.past.update(tuple(past[c] for c in EMPTY))
        yield pd.DataFrame(out, columns=["match_id", "team", "at_home", *NAMES])


def team_features(matches: DataFrame, late: str = "1 day") -> DataFrame:
    """Per streamed match (match_id, league, kickoff, home, away, goals, and shots or xg if there are any) and team: match_id, team, at_home and the features known before it."""
    log = features.team_log(matches.withWatermark("kickoff", late)).where("team is not null and match_id is not null and kickoff is not null")
    kind, team = (log.schema[c].dataType.simpleString() for c in ("match_id", "team"))
    rows = log.select("team", "match_id", "at_home", "kickoff", F.unix_micros(F.col("kickoff").cast("timestamp")).alias("kickoff_us"), *(F.col(c).cast("double").alias(c) for c in KEPT))
    schema = f"match_id {kind}, team {team}, at_home int, " + ", ".join(f"{n} {'long' if n == 'prior' else 'int' if n == 'congested' else 'double'}" for n in NAMES)
    return rows.groupBy("team").transformWithStateInPandas(TeamFeatures(kind), StructType.fromDDL(schema), "Append", "EventTime")
