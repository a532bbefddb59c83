"""Features from a stream of matches against the batch operator, late matches and a restart included."""

import datetime
import math

import numpy as np
import pytest

from touchline.operators import features
from touchline.streaming import team_features

SCHEMA = "match_id long, league string, kickoff timestamp, home string, away string, home_goals int, away_goals int, home_shots int, away_shots int"


def season(n=90):
    draw = np.random.default_rng(31)
    rows = []
    for i in range(n):
        h, a = draw.choice(list("abcdef"), 2, replace=False)
        goals = (None, None) if i % 13 == 7 else tuple(int(v) for v in draw.integers(0, 4, 2))
        shots = (None, None) if i % 7 == 3 else tuple(int(v) for v in draw.integers(2, 9, 2))
        rows.append((i, "A", datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(hours=11 * i), str(h), str(a), *goals, *shots))
    return rows


def flush(day):
    """A match far ahead moves the watermark."""
    return (10_000 + day, "A", datetime.datetime(2025, 1, 1) + datetime.timedelta(days=day), "y", "z", 0, 0, 1, 1)


def test_stream_equals_batch(spark, tmp_path):
    rows = season()
    late = [rows[k] for k in (20, 33)]
    batches = [[r for r in rows[:40] if r not in late], [*rows[40:41], *late], rows[41:70], [*rows[70:], flush(0)], [flush(60)]]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", team_features.STORE)
    try:
        for k, batch in enumerate(batches):
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
            stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
            found = team_features.team_features(stream, "9 days")
            # a new query each time goes on from the checkpoint
            query = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).outputMode("append").start()
            assert query.awaitTermination(180)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    names = ["match_id", "team", "at_home", *team_features.NAMES]
    got = {(r.match_id, r.team): r for r in spark.read.parquet(str(tmp_path / "out")).where("match_id < 10000").select(names).collect()}
    want = {(r.match_id, r.team): r for r in features.team_features(features.team_log(spark.createDataFrame(rows, SCHEMA))).select(names).collect()}
    assert got.keys() == want.keys() and len(got) == 2 * len(rows)
    for k, r in want.items():
        for n in names:
            a, b = got[k][n], r[n]
            assert a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12)), (k, n, a, b)


@pytest.mark.parametrize("played", [True, False])
def test_what_a_match_teaches(played):
    row = {"match_id": 1, "at_home": 1, "kickoff_us": 5, "pts": 3.0 if played else None, "gf": 2.0, "ga": 0.0, "sf": None, "sa": 1.0, "xgf": None, "xga": None}
    after = team_features.learned(team_features.EMPTY, row)
    assert after["prior"] == int(played) and after["home_n"] == int(played) and after["sf"] == [] and after["sa"] == ([1.0] if played else [])
