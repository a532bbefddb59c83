"""Readers and writers over landed files; streams; models."""

import datetime
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import pricing
from touchline.operators.models import boosted, calibration, dixon_coles, market_anchor
from touchline.sources import dimensions, readers, writers
from touchline.streaming import streams

CSV = """Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HTHG,HTAG,HS,AS,HST,AST,HC,AC,B365CH,B365CD,B365CA,PSCH,PSCD,PSCA,PC>2.5,PC<2.5,AHCh,PCAHH,PCAHA
16/08/2024,20:00,Man United,Fulham,1,0,H,0,0,14,10,5,2,7,8,1.6,4.2,5.25,1.63,4.38,5.3,1.5,2.6,-1,2.05,1.85
17/08/24,,Ipswich,Liverpool,0,2,A,0,0,7,18,2,5,2,10,8.5,5.5,1.33,,5.8,1.35,x,2.4,,,
18/08/2024,25:99,Arsenal,Arsenal,2,0,H,1,0,,,,,,,,,,,,,,,,,
19/08/2024,19:30,Leicester,Spurs,1,1,H,0,1,,,,,,,,,,,,,,,,,
,,,,,,,,,,,,,,,,,,,,,,,,,
nodate,15:00,A,B,1,1,D,0,0,,,,,,,,,,,,,,,,,
"""


def test_match_csv(spark, tmp_path):
    assert readers.match_file("E0", "2024-25") == "2425/E0.csv"
    (tmp_path / "2425").mkdir()
    (tmp_path / "2425" / "E0.csv").write_text(CSV)
    rows = readers.csv_rows(spark, str(tmp_path / "2425" / "E0.csv"))
    got = {x.home: x for x in readers.matches_from_csv(rows).collect()}
    assert set(got) == {"manchester_united", "ipswich"}
    m = got["manchester_united"]
    assert (m.league, m.season, m.kickoff, m.home_goals, m.away_corners, m.referee) == ("E0", "2024-25", "2024-08-16T20:00:00Z", 1, 8, None)
    assert got["ipswich"].kickoff == "2024-08-17T15:00:00Z"
    odds = readers.odds_from_csv(rows).collect()
    assert sorted((x.book, x.market, x.line) for x in odds if x.match_id == m.match_id) == sorted([("bet365", "1x2", None), ("pinnacle", "1x2", None), ("pinnacle", "ou25", 2.5), ("pinnacle", "ah", -1.0)], key=str) or len([x for x in odds if x.match_id == m.match_id]) == 4
    assert [(x.book, x.market) for x in odds if x.match_id == got["ipswich"].match_id] == [("bet365", "1x2")]


def test_json_lines_and_ledger(spark, tmp_path):
    urls = tmp_path / "u.jsonl"
    urls.write_text('{"url": "https://marca.com/1", "domain": "marca.com"}\n\nnot json\n{"url": "https://as.com/2", "domain": "as.com"}\n')
    assert [x.domain for x in readers.crawled_urls(spark, str(urls), ["marca"]).collect()] == ["marca.com"]
    book = tmp_path / "l.jsonl"
    book.write_text(json.dumps({"ticket_id": "a", "stake": 1.0, "state": "pendiente", "legs": [{"event_id": 1, "odds": 2.0}]}) + "\n{bad\n")
    tickets, bad = readers.ledger(spark, str(book))
    assert [x.ticket_id for x in tickets.collect()] == ["a"] and [x.line for x in bad.collect()] == ["{bad"]
    table = str(tmp_path / "ledger")
    writers.replace_table(tickets, table)
    current = spark.read.schema(readers.LEDGER).json(table)
    writers.replace_table(current.withColumn("state", F.lit("liquidado")), table)
    assert spark.read.schema(readers.LEDGER).json(table).first().state == "liquidado" and len([p for p in tmp_path.iterdir() if p.name.startswith("ledger")]) == 1


def test_partitioned_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.append(spark.createDataFrame([(1, "a"), (2, "b")], "x int, day string"), path, "day")
    writers.append(spark.createDataFrame([(3, "b")], "x int, day string"), path, "day")
    writers.overwrite_partitions(spark.createDataFrame([(9, "a")], "x int, day string"), path, "day")
    assert sorted(x.x for x in readers.partitioned(spark, path).collect()) == [2, 3, 9]
    assert sorted(x.x for x in readers.partitioned(spark, path, latest_by="day").collect()) == [2, 3]
    assert writers.report(spark.createDataFrame([(1, "a")], "n int, s string"), str(tmp_path / "r.json")) == {"n": 1, "s": "a"} == json.loads((tmp_path / "r.json").read_text())
    writers.json_lines(spark.range(5), str(tmp_path / "j"), per_file=2)
    assert spark.read.json(str(tmp_path / "j")).count() == 5


def test_facts_views(spark, tmp_path):
    names = [x.split()[0] for x in readers.FACTS.split(", ")]
    rows = [["f1", "article_text", "u", "d", "{}", "s", at, None, 200, None, None, None, None, None, None, "2024-01-01"] for at in ("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")]
    writers.append(spark.createDataFrame(rows, readers.FACTS).select(*names), str(tmp_path / "facts"), "partition_date")
    readers.facts_views(spark, str(tmp_path / "facts"))
    assert spark.sql("SELECT count(*) AS n FROM facts_raw").first().n == 2
    assert spark.sql("SELECT extracted_at FROM facts").collect()[0].extracted_at == "2024-01-02T00:00:00Z"


def test_dimensions(spark):
    assert dimensions.seeds(spark).select("domain").distinct().count() == 55 and dimensions.leagues(spark).count() == 9
    assert dimensions.feed_leagues(spark).groupBy("country", "league_key").count().where("count > 1").count() == 0 and dimensions.scorer_leagues(spark).count() == 9


def run(query_of, spark, tmp_path, name, mode="append"):
    q = query_of.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    schema = "outcome_id long, captured_at timestamp, odds double"
    for day in (1, 2):
        rows = [(k, f"2024-01-0{day} 10:00:00", 2.0 + day * k / 10) for k in range(4)] + [(0, f"2024-01-0{day} 10:30:00", 1.5)]
        spark.createDataFrame(rows, "outcome_id long, captured_at string, odds double").withColumn("captured_at", F.to_timestamp("captured_at")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: streams.captures(spark, str(tmp_path / "in"), schema)
    assert len(run(streams.first_seen(stream(), "outcome_id", "captured_at", "10 days"), spark, tmp_path, "seen")) == 4
    rows = run(streams.windowed(stream(), "captured_at", "1 hour", ["outcome_id"], "odds"), spark, tmp_path, "win")
    assert {(x.outcome_id, x.n) for x in rows} >= {(0, 2), (1, 1)}
    moves = {x.outcome_id: x for x in run(streams.price_moves(stream()), spark, tmp_path, "moves", "update")}
    assert moves[0].n == 4 and moves[0].lo == 1.5 and moves[3].hi == pytest.approx(2.6)
    assert {x.n for x in run(streams.sessions(stream(), "captured_at", "45 minutes", "outcome_id"), spark, tmp_path, "ses")} <= {1, 2}


# ---- models


def results(spark, teams=10, rounds=60):
    r, draw = random.Random(3), np.random.default_rng(3)
    att = {t: (t - teams / 2) / teams for t in range(teams)}
    rows = []
    for k in range(rounds):
        order = list(range(teams))
        r.shuffle(order)
        for i in range(0, teams, 2):
            h, a = order[i], order[i + 1]
            rows.append((len(rows), "A", f"{2020 + k // 12}-{1 + k % 12:02d}-01", h, a, int(draw.poisson(math.exp(att[h] - att[a] / 2 + 0.3))), int(draw.poisson(math.exp(att[a] - att[h] / 2)))))
    return spark.createDataFrame(rows, "match_id long, league string, kickoff string, home int, away int, home_goals int, away_goals int").withColumn("kickoff", F.to_timestamp("kickoff"))


def test_strengths_are_recovered(spark):
    got = dixon_coles.strengths(results(spark), "league", half_life=5000).collect()
    order = [x.attack for x in sorted(got, key=lambda x: x.team)]
    assert np.corrcoef(order, range(10))[0, 1] > 0.9 and abs(sum(order)) < 1e-6 and 0.1 < got[0].home_edge < 0.5 and abs(got[0].rho) <= 0.2
    assert dixon_coles.strengths(results(spark, rounds=4), "league").count() == 0


def test_gradient():
    draw = np.random.default_rng(0)
    n, m = 4, 60
    home, away = draw.integers(0, n, m), draw.integers(0, n, m)
    args = (n, home, away, draw.integers(0, 3, m).astype(float), draw.integers(0, 3, m).astype(float), draw.random(m))
    x = draw.normal(0, 0.2, 2 * n + 2) * np.r_[np.ones(2 * n), 0.5, 0.3]
    _, g = dixon_coles._gradient(x, *args)
    for i in range(len(x)):
        e = np.zeros(len(x))
        e[i] = 1e-6
        assert (dixon_coles._gradient(x + e, *args)[0] - dixon_coles._gradient(x - e, *args)[0]) / 2e-6 == pytest.approx(g[i], abs=1e-4)


def forecasts(spark, n=600, bias=0.0):
    draw = np.random.default_rng(11)
    p = draw.dirichlet((2, 2, 2), n)
    y = [int(draw.choice(3, p=row)) for row in p]
    q = p + bias * np.array([1, 0, -1])
    q = np.clip(q, 0.01, 1)
    q /= q.sum(axis=1, keepdims=True)
    return spark.createDataFrame([(i, *map(float, q[i]), y[i]) for i in range(n)], "k int, p1 double, px double, p2 double, y int")


def test_isotonic(spark):
    from touchline.operators.metrics import brier

    few = calibration.ClassIsotonic().fit_checked(forecasts(spark, 90), "k")
    assert not few.fitted and few.transform(forecasts(spark, 5)).collect() == forecasts(spark, 5).collect()
    off = forecasts(spark, 1500, bias=0.35)
    model = calibration.ClassIsotonic().fit_checked(off, "k")
    assert model.fitted
    fixed = model.transform(off)
    assert fixed.agg(brier().alias("b")).first().b < off.agg(brier().alias("b")).first().b
    assert fixed.where(F.abs(F.col("p1") + F.col("px") + F.col("p2") - 1) > 1e-9).count() == 0


def test_residual_starts_from_the_market(spark):
    rows = forecasts(spark, 400).select(F.lit("A").alias("league"), F.col("k").alias("match_id"), F.when(F.col("k") < 300, "train").otherwise("test").alias("split"), F.col("p1").alias("q1"), F.col("px").alias("qx"), F.col("p2").alias("q2"), "y", F.lit(None).cast("double").alias("f"))
    kept = market_anchor.residual(rows, ["f"], "league", least=10**6).join(rows, ["league", "match_id"]).collect()
    assert len(kept) == 100 and all(abs(x.r1 - x.q1) < 1e-9 for x in kept)
    shifted = market_anchor.residual(rows, ["f"], "league", ridge=50.0).collect()
    assert all(abs(x.r1 + x.rx + x.r2 - 1) < 1e-9 for x in shifted)


def test_ensemble_and_boosting(spark):
    with pytest.raises(ValueError, match="more than 0"):
        calibration.ensemble(forecasts(spark, 5), {"a": 0.0})
    draw = random.Random(1)
    rows = spark.createDataFrame([(i, x, None if i % 9 == 0 else 1.0, 0 if x > 0.3 else 1 if x > 0 else 2) for i in range(300) for x in [draw.uniform(-1, 1)]], "k int, f double, g double, y int")
    scored, models = boosted.boosted(rows, rows, ["f", "g"], rounds=5)
    assert len(models) == 3 and scored.where("abs(p1 + px + p2 - 1) > 1e-9").count() == 0
    assert scored.where("(p1 >= px and p1 >= p2) = (y = 0)").count() > 270


def test_all_matches_are_priced(spark):
    """Every match of the table, against plain score grids of the fitted strengths."""
    from touchline.plans import model_queries

    rows = spark.createDataFrame([(r, r % 2, 2000, datetime.date(2020, 1, 1) + datetime.timedelta(days=r // 8), r % 2 * 10 + r // 2 % 6, r % 2 * 10 + (r // 2 % 6 + 1 + r // 12 % 5) % 6, r * 7 % 5 % 4, r * 3 % 7 % 3) for r in range(480)], "match_id long, league int, season int, kickoff date, home int, away int, home_goals int, away_goals int")

    class Given:
        def sql(self, text):
            return rows

    got = {(x.match_id, x.selection): x.win for x in model_queries.q_dixon_coles_markets(Given()).collect()}
    fit = {(int(x.key), x.team): x for x in dixon_coles.strengths(rows.withColumns({"kickoff": F.col("kickoff").cast("timestamp"), "key": F.col("league").cast("string")}), "key").collect()}
    assert len(fit) == 12 and len(got) == 3 * 480
    poisson = lambda k, m: math.exp(-m) * m**k / math.factorial(k)
    for m in rows.collect():
        h, a = (fit[m.league, str(t)] if (m.league, str(t)) in fit else fit[m.league, t] for t in (m.home, m.away))
        lam, mu = min(math.exp(h.attack + a.defence + h.home_edge), pricing.MOST), min(math.exp(a.attack + h.defence), pricing.MOST)
        tau = {(0, 0): 1 - lam * mu * h.rho, (0, 1): 1 + lam * h.rho, (1, 0): 1 + mu * h.rho, (1, 1): 1 - h.rho}
        grid = {(x, y): max(poisson(x, lam) * poisson(y, mu) * tau.get((x, y), 1), 0) for x in range(pricing.GOALS) for y in range(pricing.GOALS)}
        total = sum(grid.values())
        want = [sum(p for (x, y), p in grid.items() if (x > y) - (x < y) == s) / total for s in (1, 0, -1)]
        assert [got[m.match_id, s] for s in ("1", "X", "2")] == pytest.approx(want, abs=1e-4)
