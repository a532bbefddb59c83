"""Sources by name, files that conditions leave unread, and tables that follow their landing folder."""

import json
import os

import pytest

from touchline.sources import landed, readers

HEAD = "Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR,PSCH,PSCD,PSCA"


def put(folder, season, league, *rows):
    os.makedirs(folder / season, exist_ok=True)
    path = folder / season / f"{league}.csv"
    path.write_text("﻿" + "\n".join([HEAD, *rows]) + "\n", encoding="utf-8")
    return path


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    put(folder, "2324", "E0", "E0,12/08/2023,15:00,Arsenal,Everton,2,1,H,1.5,4.2,6.5", "E0,13/08/2023,,Chelsea,Fulham,0,0,D,1.8,3.6,4.5")
    put(folder, "2425", "E0", "E0,17/08/2024,12:30,Everton,Arsenal,0,3,A,5.5,4.1,1.6")
    put(folder, "2425", "SP1", "SP1,18/08/2024,21:00,Sevilla,Betis,1,1,D,2.1,3.3,3.6")
    put(folder, "notes", "E0", "x")
    return folder


def test_matches_by_name(spark, landing):
    landed.register(spark)
    rows = spark.read.format("landed_matches").option("path", str(landing)).load()
    matches = readers.matches_from_csv(rows)
    assert {(r.league, r.season, r.home, r.home_goals) for r in matches.collect()} == {("E0", "2023-24", "arsenal", 2), ("E0", "2023-24", "chelsea", 0), ("E0", "2024-25", "everton", 0), ("SP1", "2024-25", "sevilla", 1)}
    assert readers.odds_from_csv(rows).where("book = 'pinnacle' and market = '1x2'").count() == 4


@pytest.mark.parametrize(("condition", "files"), [("league = 'E0'", 2), ("season in ('2024-25')", 2), ("league = 'E0' and season = '2024-25'", 1), ("season = '1999-00'", 0), ("HomeTeam = 'Sevilla'", 3), ("league in ('E0', 'SP1') and league = 'SP1'", 1)])
def test_conditions_prune_files(spark, landing, condition, files):
    landed.register(spark)
    rows = spark.read.format("landed_matches").option("path", str(landing)).load().where(condition)
    assert rows.rdd.getNumPartitions() == max(files, 0) or files == 0
    everything = spark.read.format("landed_matches").option("path", f"file://{landing}").load().collect()
    assert rows.count() == sum(eval(condition.replace(" = ", " == ").replace("('2024-25')", "('2024-25',)"), {}, r.asDict()) for r in everything)


def test_feed_by_name(spark, tmp_path):
    os.makedirs(tmp_path / "2024-05-01T10")
    (tmp_path / "2024-05-01T10" / "liga.json").write_text(json.dumps({"events": []}))
    landed.register(spark)
    assert [tuple(r) for r in spark.read.format("landed_feed").option("path", str(tmp_path)).load().collect()] == [("liga", "2024-05-01T10", '{"events": []}')]


def test_refresh_reads_what_changed(spark, landing, tmp_path):
    table, manifest = str(tmp_path / "matches"), str(tmp_path / "manifest")
    go = lambda: landed.refresh(spark, str(landing), table, manifest, readers.matches_from_csv)
    assert go() == [("2023-24", "E0"), ("2024-25", "E0"), ("2024-25", "SP1")]
    assert spark.read.parquet(table).count() == 4 and go() == []
    old = os.path.getmtime(landing / "2324" / "E0.csv")
    fresh = put(landing, "2425", "E0", "E0,17/08/2024,12:30,Everton,Arsenal,1,3,A,5.5,4.1,1.6", "E0,24/08/2024,12:30,Fulham,Arsenal,1,1,D,5.5,4.1,1.6")
    os.utime(fresh, (old + 100, old + 100))
    before = {p: os.path.getmtime(os.path.join(d, p)) for d, _, names in os.walk(table) for p in names if "E0" in d and "2023-24" in d}
    assert go() == [("2024-25", "E0")]
    rows = {(r.season, r.league, r.home, r.home_goals) for r in spark.read.parquet(table).collect()}
    assert rows == {("2023-24", "E0", "arsenal", 2), ("2023-24", "E0", "chelsea", 0), ("2024-25", "E0", "everton", 1), ("2024-25", "E0", "fulham", 1), ("2024-25", "SP1", "sevilla", 1)}
    assert before == {p: os.path.getmtime(os.path.join(d, p)) for d, _, names in os.walk(table) for p in names if "E0" in d and "2023-24" in d}
    assert go() == []


def test_seasons_of_folders():
    assert [landed.season_of(x) for x in ("2425", "9900", "0001", "x", "242")] == ["2024-25", "1999-00", "2000-01", None, None]
