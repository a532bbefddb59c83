"""Distributed fits against plain numpy versions, and lines of every market and period against score grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import pricing, tickets
from touchline.operators.models import boosted, calibration, dixon_coles, market_anchor, trees
from touchline.plans import walkforward


def sample(n=500, seed=2):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3)).round(1)
    x[draw.random((n, 3)) < 0.2] = np.nan
    z = np.column_stack([np.nan_to_num(x[:, 0]), np.zeros(n), np.where(np.isnan(x[:, 1]), 1.5, -0.5)])
    p = trees.softmax(z)
    y = (draw.random(n)[:, None] > np.cumsum(p, axis=1)[:, :2]).sum(axis=1)
    q = draw.dirichlet((4, 4, 4), n)
    return x, y, q


COLUMNS = "match_id long, fold string, split string, y int, a double, b double, c double, q1 double, qx double, q2 double"


def table(spark, x, y, q, fold="f", val=False):
    cell = lambda v: None if math.isnan(v) else float(v)
    return spark.createDataFrame([(i, fold, "val" if val and i % 5 == 4 else "train", int(y[i]), *map(cell, x[i]), *map(float, q[i])) for i in range(len(y))], COLUMNS)


def plainly_boosted(x, y, start, edges, growth):
    """The same boosting by loops over nodes, features, cuts and sides of missing values."""
    margin = start.copy()
    for _ in range(growth.rounds):
        p = trees.softmax(margin)
        moved = np.zeros_like(margin)
        for k in range(3):
            g, h = p[:, k] - (y == k), np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
            parts = [np.arange(len(y))]
            for _ in range(growth.depth):
                after = []
                for rows in parts:
                    score = lambda r, g=g, h=h: g[r].sum() ** 2 / (h[r].sum() + growth.ridge)
                    best, chosen = 1e-9, (rows, rows[:0])
                    for f in range(x.shape[1]):
                        for c in range(growth.bins - 1):
                            for left_missing in (True, False):
                                v = x[rows, f]
                                low = np.where(np.isnan(v), left_missing, (1 + np.searchsorted(edges[f], v)) <= c + 1)
                                low, high = rows[low], rows[~low]
                                if min(len(low), len(high)) >= growth.least and (gain := score(low) + score(high) - score(rows)) > best + 1e-10:
                                    best, chosen = gain, (low, high)
                    after += chosen
                parts = after
            for rows in parts:
                moved[rows, k] = -growth.rate * g[rows].sum() / (h[rows].sum() + growth.ridge)
        margin += moved
    return trees.softmax(margin)


@pytest.mark.parametrize("offset", [None, ("q1", "qx", "q2")])
def test_boosting_equals_plain_boosting(spark, offset):
    x, y, q = sample()
    growth = trees.Growth(rounds=3, depth=2, bins=6, least=15, ridge=2.0, rate=0.3)
    rows = table(spark, x, y, q).repartition(5)
    model = trees.fit(rows, "fold", ["a", "b", "c"], offset=offset, growth=growth)
    forest = model.forests["f"]
    assert len(forest.trees) == 3
    start = np.log(q) if offset else np.tile(forest.start, (len(y), 1))
    want = plainly_boosted(x, y, start, forest.edges, growth)
    got = np.array([r[1:] for r in sorted(model.transform(rows, "fold", offset).select("match_id", "p1", "px", "p2").collect())])
    assert np.abs(got - want).max() < 1e-9
    assert [name for name, _ in model.importances("f")][0] in ("a", "b")


def test_boosting_stops_and_keeps_groups_apart(spark):
    x, y, q = sample(900)
    noise = np.random.default_rng(1).integers(0, 3, 900)
    growth = trees.Growth(rounds=20, depth=2, bins=8, patience=2)
    one = table(spark, x, y, q, "f", val=True)
    both = one.unionByName(table(spark, x, noise, q, "g", val=True))
    model, alone = trees.fit(both, "fold", ["a", "b", "c"], growth=growth), trees.fit(one, "fold", ["a", "b", "c"], growth=growth)
    f, g = model.forests["f"], model.forests["g"]
    assert g.best < f.best == alone.forests["f"].best == len(f.trees)
    assert f.losses[f.best] == min(f.losses) and np.allclose(f.losses, alone.forests["f"].losses)
    p = model.transform(both.withColumn("fold", F.lit("other")).limit(3), "fold").collect()
    assert all(r.p1 is None for r in p)
    assert trees.fit(both.limit(0), "fold", ["a"]).forests == {}


def test_without_trees_and_shifts_the_market_stays(spark):
    x, y, q = sample(60)
    rows = table(spark, x, y, q)
    still = trees.fit(rows, "fold", ["a", "b", "c"], offset=("q1", "qx", "q2"), growth=trees.Growth(rounds=0)).transform(rows, "fold", ("q1", "qx", "q2"))
    zero = market_anchor.Shift(["a"], {}, {}).transform(rows, "fold", ("p1", "px", "p2"))
    for found in (still, zero):
        assert all(abs(r.p1 - r.q1) + abs(r.px - r.qx) + abs(r.p2 - r.q2) < 1e-12 for r in found.collect())


def test_shift_is_the_ridge_optimum(spark):
    x, y, q = sample(400)
    model = market_anchor.fit_shift(table(spark, x, y, q).repartition(4), ["a", "b", "c"], "fold", ridge=3.0)
    m, w = model.matrix("f", x), model.weights["f"]
    p = trees.softmax(np.log(q) + m @ w)
    assert np.abs(m.T @ (p - np.eye(3)[y]) + 3.0 * w).max() < 1e-4 and np.abs(w).max() > 0.01
    assert np.abs(m[:, :3].mean(axis=0)).max() < 1e-9


def test_goal_model_needs_sums_only(spark):
    draw = np.random.default_rng(4)
    n = 600
    home = draw.integers(0, 8, n)
    away = (home + draw.integers(1, 8, n)) % 8
    goals = draw.poisson(1.4, (n, 2))
    rows = spark.createDataFrame([("x", i % 200, int(h), int(a), int(g[0]), int(g[1])) for i, (h, a, g) in enumerate(zip(home, away, goals, strict=True))], "league string, day int, home int, away int, home_goals int, away_goals int")
    rows = rows.withColumn("kickoff", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("day") * 86400))
    cells = dixon_coles.cells(rows, "league").toPandas()
    assert cells["n"].sum() == n and len(cells) == len({(h, a, *g) for h, a, g in zip(home.tolist(), away.tolist(), map(tuple, goals.tolist()), strict=True)})
    weight = 0.5 ** ((199 - np.arange(n) % 200) / 365)
    assert cells["w"].sum() == pytest.approx(weight.sum())
    x = dixon_coles.fit(home, away, goals[:, 0].astype(float), goals[:, 1].astype(float), weight, 8)
    _, g = dixon_coles._gradient(x, 8, home, away, goals[:, 0].astype(float), goals[:, 1].astype(float), weight)
    inner = np.r_[np.full(17, True), abs(x[17]) < 0.2]
    assert np.abs(g[inner]).max() < 1e-4
    got = sorted((r.team, r.attack, r.defence, r.rho) for r in dixon_coles.strengths(rows, "league").collect())
    assert np.allclose([r[1] for r in got], x[:8], atol=1e-6) and np.allclose([r[2] for r in got], x[8:16], atol=1e-6)


def test_isotonic_by_key_equals_one_fit(spark):
    draw = np.random.default_rng(12)
    p = draw.dirichlet((2, 2, 2), 900).round(3)
    p[:, 2] = (1 - p[:, 0] - p[:, 1]).round(3)
    y = [int(draw.choice(3, p=np.clip(r, 0, None) ** 2 / (np.clip(r, 0, None) ** 2).sum())) for r in p]
    rows = spark.createDataFrame([("a" if i % 2 else "b", i, *map(float, p[i]), y[i]) for i in range(900)], "fold string, k int, p1 double, px double, p2 double, y int")
    fixed = {r.k: r for r in calibration.curved(rows, calibration.isotonic(rows, "fold"), "fold").collect()}
    for fold in "ab":
        one = rows.where(F.col("fold") == fold)
        for r in calibration.ClassIsotonic().fit(one).transform(one).collect():
            assert (fixed[r.k].p1, fixed[r.k].px, fixed[r.k].p2) == pytest.approx((r.p1, r.px, r.p2), abs=1e-9)


def test_controlled_calibration_by_fold(spark):
    draw = np.random.default_rng(13)

    def fold(name, n, bias):
        p = draw.dirichlet((2, 2, 2), n)
        y = [int(draw.choice(3, p=r)) for r in p]
        q = np.clip(p + bias * np.array([1, 0, -1]), 0.01, 1)
        q /= q.sum(axis=1, keepdims=True)
        return [(name, i, *map(float, q[i]), y[i]) for i in range(n)]

    rows = spark.createDataFrame(fold("off", 1200, 0.35) + fold("few", 150, 0.35) + fold("right", 300, 0.0), "fold string, k int, p1 double, px double, p2 double, y int")
    curves, state = calibration.controlled(rows, "fold", "k")
    state = {r.fold: r for r in state.collect()}
    assert state["off"].fitted and state["off"].after < state["off"].before and state["few"].reason == "too few rows" and state["few"].n == 150
    kept = calibration.curved(rows, curves, "fold")
    assert kept.where("fold = 'few'").exceptAll(rows.where("fold = 'few'")).count() == 0
    assert {r.fold for r in curves.select("fold").collect()} == {f for f, r in state.items() if r.fitted}


def test_verdicts(spark):
    rows = spark.createDataFrame([(1, 0, *m, *q) for m, q in [((0.5, 0.3, 0.2), (0.5, 0.3, 0.2))] * 4], "fold int, y int, model_p1 double, model_px double, model_p2 double, market_p1 double, market_px double, market_p2 double")
    read = lambda df: walkforward.verdict(df, ("model", "market")).first().reading
    assert read(rows) == "even"
    assert read(rows.withColumns({"model_p1": F.lit(0.6), "model_px": F.lit(0.2)})) == "edge" and read(rows.withColumns({"model_p1": F.lit(0.4), "model_px": F.lit(0.4)})) == "worse"


def test_importances_keep_their_names(spark):
    rows = spark.createDataFrame([(i, None, float(i % 7), float(i), 0 if i > 150 else 1 + i % 2) for i in range(300)], "k int, empty double, other double, told double, y int")
    _, models = boosted.boosted(rows, rows, ["empty", "other", "told"], rounds=3)
    assert models.features == ["other", "told"] and boosted.importances(models)[0][0] == "told"


def test_repeated_outcomes_are_on_one_ticket(spark):
    legs = spark.createDataFrame([("d", e, e, 3.0, 0.1 / e) for e in range(1, 7)] * 2, "day string, event_id int, outcome_id int, odds double, ev double")
    rows = tickets.greedy(legs, target=9.0, tickets=6).collect()
    assert len(rows) == len({r.outcome_id for r in rows}) == 6


# ---- lines

HOME, AWAY = "Real Madrid", "Sevilla"
GRIDS = {"": (1.6, 1.1), " - 1ª parte": (0.7, 0.45), " - 2ª parte": (0.9, 0.65)}
#: market, label, participant, line, and what of (home goals, away goals) wins or is returned (shares of the stake), for the home side's markets.
MARKETS = [
    ("Resultado Final", "1", None, None, lambda h, a: (h > a, 0)), ("Resultado Final", "X", None, None, lambda h, a: (h == a, 0)), ("Resultado Final", "2", None, None, lambda h, a: (h < a, 0)),
    ("Doble Oportunidad", "1 o X", None, None, lambda h, a: (h >= a, 0)), ("Doble Oportunidad", "12", None, None, lambda h, a: (h != a, 0)), ("Doble Oportunidad", "X o 2", None, None, lambda h, a: (h <= a, 0)),
    ("Apuesta sin empate", "x", HOME, None, lambda h, a: (h > a, h == a)), ("Apuesta sin empate", "x", AWAY, None, lambda h, a: (h < a, h == a)),
    ("Ambos Equipos Marcarán", "Sí", None, None, lambda h, a: (h > 0 and a > 0, 0)), ("Ambos Equipos Marcarán", "No", None, None, lambda h, a: (h == 0 or a == 0, 0)),
    ("Resultado Correcto", "2-1", None, None, lambda h, a: ((h, a) == (2, 1), 0)), ("Resultado Correcto", "0 - 0", None, None, lambda h, a: ((h, a) == (0, 0), 0)),
    ("Total de goles", "Más de", None, 2.5, lambda h, a: (h + a > 2.5, 0)), ("Total de goles", "Menos de", None, 3.0, lambda h, a: (h + a < 3, h + a == 3)), ("Total de goles", "Más de", None, 12.5, lambda h, a: (h + a > 12, 0)),
    ("Total asiático", "Más de", None, 2.25, lambda h, a: ((h + a > 2) / 2 + (h + a > 2.5) / 2, (h + a == 2) / 2)),
    (f"Total de goles de {HOME}", "Más de", None, 1.5, lambda h, a: (h > 1.5, 0)), (f"Total de goles de {AWAY}", "Menos de", None, 1.0, lambda h, a: (a < 1, a == 1)),
    ("Hándicap asiático", "x", HOME, -0.75, lambda h, a: ((h - a > 0.5) / 2 + (h - a > 1) / 2, (h - a == 1) / 2)), ("Hándicap asiático", "x", AWAY, 0.5, lambda h, a: (a + 0.5 > h, 0)), ("Hándicap", "x", AWAY, -1.0, lambda h, a: (a - 1 > h, a - 1 == h)),
    ("Hándicap 3-Way", "1", None, -1.0, lambda h, a: (h - 1 > a, 0)), ("Hándicap 3-Way", "X", None, -1.0, lambda h, a: (h - 1 == a, 0)), ("Hándicap 3-Way", "2", None, 1.0, lambda h, a: (h + 1 < a, 0)),
]
UNPRICED = [("Tarjetas", "x", None, None), ("Total de goles", "Más de", None, None), ("Resultado Correcto", "otro", None, None), ("Resultado Correcto", "10-0", None, None), ("Total de goles de Otro", "Más de", None, 1.5), ("Hándicap de Tiros de Esquina", "x", HOME, 1.5)]


def test_lines_of_every_market_and_period(spark):
    lines = [(1, k, m + suffix, label, who, line) for k, (m, label, who, line, _) in enumerate(MARKETS) for suffix in GRIDS]
    lines += [(1, 1000, *u) for u in UNPRICED] + [(1, 2000, "Total de Tiros de Esquina", "Más de", None, 9.5), (1, 2001, "Total de Tiros de Esquina", "Menos de", None, 10.0), (2, 3000, "Resultado Final - 1ª parte", "1", None, None), (9, 3001, "Resultado Final", "1", None, None), (None, 3002, "Resultado Final", "1", None, None)]
    df = spark.createDataFrame([(*x, HOME, AWAY, 2.0) for x in lines], "match_id long, k int, market string, label string, participant string, line double, home_name string, away_name string, odds double")
    rates = spark.createDataFrame([(1, *GRIDS[""], -0.1, *GRIDS[" - 1ª parte"], 0.05, *GRIDS[" - 2ª parte"], 0.0, 10.2), (2, 1.0, 1.0, 0.0, None, None, None, None, None, None, None)], "match_id long, lam double, mu double, rho double, lam_ht double, mu_ht double, rho_ht double, lam_st double, mu_st double, rho_st double, corners double")
    got = pricing.price_lines(df, rates).collect()
    assert len(got) == len(lines)
    rhos = {"": -0.1, " - 1ª parte": 0.05, " - 2ª parte": 0.0}
    for suffix, (lam, mu) in GRIDS.items():
        mass = lambda k, m: math.exp(-m) * m**k / math.factorial(k)
        rho = rhos[suffix]
        tau = {(0, 0): 1 - lam * mu * rho, (0, 1): 1 + lam * rho, (1, 0): 1 + mu * rho, (1, 1): 1 - rho}
        grid = {(h, a): mass(h, lam) * mass(a, mu) * tau.get((h, a), 1) for h in range(10) for a in range(10)}
        total = sum(grid.values())
        by = {r.k: r for r in got if r.k < 1000 and r.market.endswith(suffix) and (suffix or "parte" not in r.market)}
        for k, (*_, rule) in enumerate(MARKETS):
            win, push = (sum(p * float(rule(*cell)[i]) for cell, p in grid.items()) / total for i in (0, 1))
            assert (by[k].win, by[k].push, by[k].lose) == pytest.approx((win, push, 1 - win - push), abs=1e-12), MARKETS[k]
            assert by[k].covered and by[k].ev == pytest.approx(win - by[k].lose)
    assert all(not r.covered and r.p is None and r.ev is None for r in got if r.k in (1000, 3000, 3001, 3002))
    corner = [math.exp(k * math.log(10.2) - math.lgamma(k + 1)) for k in range(31)]
    by = {r.k: r for r in got}
    assert by[2000].win == pytest.approx(sum(corner[10:]) / sum(corner)) and by[2001].push == pytest.approx(corner[10] / sum(corner))


def test_results_are_resolved_over_both_days(spark):
    """A name that fits one club on its day and another on the next stays open; a club on the next day only is found."""
    import datetime

    from touchline.operators import entity

    day = datetime.date(2024, 5, 4)
    events = spark.createDataFrame([(1, "E0", day, "Dinamo"), (2, "E0", day, "Betis")], "event_id int, league string, day date, home_name string")
    results = spark.createDataFrame([(10, "E0", day, "dinamo_alfa", 1), (11, "E0", day + datetime.timedelta(1), "dinamo_beta", 2), (12, "E0", day + datetime.timedelta(1), "betis", 3), (13, "E0", day + datetime.timedelta(2), "betis", 4)], "result_id int, league string, day date, home_name string, goals int")
    assert [(r.event_id, r.goals) for r in entity.results_for(events, results).collect()] == [(2, 3)]


# ---- ratings


def rated(rows, start=1500.0):
    """One pass over all matches, whatever their leagues."""
    elo, out = {}, {}
    for i, _, _, h, a, x, y in sorted(rows, key=lambda r: (r[1], r[0])):
        eh, ea = elo.get(h, start), elo.get(a, start)
        e = 1 / (1 + 10 ** (-(eh + 60 - ea) / 400))
        out[i] = (eh, ea, e)
        if x is not None and y is not None:
            move = 20 * (1 + math.log1p(abs(x - y))) * ((x > y) + 0.5 * (x == y) - e)
            elo[h], elo[a] = eh + move, ea - move
    return out, elo


def fixture_list(n=260):
    """Two leagues of four and a third one apart; team 3 is promoted halfway, and some matches aren't played."""
    import datetime

    draw = np.random.default_rng(21)
    rows = []
    for i in range(n):
        league = int(draw.integers(3))
        teams = [[0, 1, 2, 3], [4, 5, 6, 7], [20, 21, 22, 23]][league]
        if i > n // 2 and league < 2:
            teams = [[0, 1, 2], [3, 4, 5, 6, 7]][league]
        h, a = map(int, draw.choice(teams, 2, replace=False))
        x, y = (int(v) for v in draw.integers(0, 4, 2))
        rows.append((i, datetime.datetime(2019, 1, 1) + datetime.timedelta(days=i * 4), "ABC"[league], h, a, *((None, None) if i % 17 == 5 else (x, y))))
    return rows


FIXTURE = "match_id long, kickoff timestamp, league string, home long, away long, home_goals int, away_goals int"


def test_ratings_survive_promotion_and_go_on(spark):
    from touchline.operators import elo

    rows = fixture_list()
    want, last = rated(rows)
    found, state = elo.run(spark.createDataFrame(rows, FIXTURE))
    got = {r.match_id: (r.home_elo, r.away_elo, r.home_expectation) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert {r.team: r.elo for r in state.collect()} == pytest.approx(last)
    cut = [r for r in rows if r[1].year < 2021], [r for r in rows if r[1].year >= 2021]
    _, half = elo.run(spark.createDataFrame(cut[0], FIXTURE))
    rest, end = elo.run(spark.createDataFrame(cut[1], FIXTURE), half)
    assert {r.team: r.elo for r in end.collect()} == pytest.approx(last)
    assert all((r.home_elo, r.away_elo, r.home_expectation) == pytest.approx(want[r.match_id]) for r in rest.collect())
    empty, none = elo.run(spark.createDataFrame([], FIXTURE))
    assert empty.count() == none.count() == 0


def test_components(spark):
    from touchline.operators import elo

    chain = [(i, i + 1) for i in range(40, 5, -1)] + [(100, 101), (101, 102), (200, None)]
    got = {r.team: r.component for r in elo.components(spark.createDataFrame(chain, "home int, away int")).collect()}
    assert got == {**dict.fromkeys(range(6, 42), 6), 100: 100, 101: 100, 102: 100}


# ---- medians


@pytest.mark.parametrize("last", [1, 3, 2048])
def test_medians_by_counting(spark, last):
    from touchline.operators.medians import medians

    draw = np.random.default_rng(41)
    groups = {"odd": draw.normal(size=301), "even": draw.normal(size=400) * 10.0 ** draw.integers(-9, 9, 400), "ties": np.repeat([1.0, 2.0, 5.0], [40, 1, 39]), "one": np.array([7.0]), None: draw.integers(0, 4, 90) / 3, "huge": np.array([-1.7e308, 1.7e308, 1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("odd", None), ("none", None), ("odd", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r.k: r.median for r in medians(df, ["k"], "v", buckets=8, last=last).collect()}
    half = lambda x: float((np.sort(x)[(len(x) - 1) // 2] / 2) + np.sort(x)[len(x) // 2] / 2)
    assert got == pytest.approx({k: half(x) for k, x in groups.items()}, rel=1e-14)
    assert medians(df, [], "v").first().median == pytest.approx(half(np.concatenate(list(groups.values()))))
    assert medians(df.limit(0), ["k"], "v").count() == 0
