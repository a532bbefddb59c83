"""Queries over odds, forecasts and captures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.odds import result_letter
from touchline.operators import diagnosis, feed, market, metrics
from touchline.operators.models import calibration, market_anchor
from touchline.plans.base import query, rounded
from touchline.plans.fixtures import MATCH, ODDS, PRED, SNAPSHOT, Tables

_O = f"WITH o AS ({ODDS}), i AS (SELECT *, CASE WHEN (odds_1 > 1)::INT + coalesce((odds_x > 1)::INT, 0) + (odds_2 > 1)::INT >= 2 THEN 1 / odds_1 + coalesce(1 / odds_x, 0) + 1 / odds_2 END AS total FROM o) "


@query(_O + "SELECT match_id, book, round(total, 6) AS total, round(1 / odds_1 / total, 6) AS p1, round(1 / odds_x / total, 6) AS px, round(1 / odds_2 / total, 6) AS p2 FROM i")
def q_implied(t: Tables) -> DataFrame:
    return rounded(market.with_implied(t.sql(ODDS)).select("match_id", "book", "total", "p1", "px", "p2"), "total", "p1", "px", "p2")


@query(_O + f", m AS ({MATCH}), b AS (SELECT match_id, 1 / odds_1 / total AS p1, 1 / odds_x / total AS px, 1 / odds_2 / total AS p2 FROM i WHERE book = 'pinnacle' AND odds_x IS NOT NULL) SELECT m.match_id, round(p1, 6) AS p1, round(px, 6) AS px, round(p2, 6) AS p2 FROM m LEFT JOIN b ON m.match_id = b.match_id")
def q_closing_probabilities(t: Tables) -> DataFrame:
    odds = t.sql(ODDS).withColumn("kickoff", F.lit(0))
    return rounded(market.closing_probabilities(t.sql(MATCH).select("match_id"), odds, "pinnacle"), "p1", "px", "p2")


@query(_O + "SELECT book, count(*) AS n, round(avg(total), 6) AS mean_total, round((avg(total) - 1) * 100, 6) AS margin_pct, avg(total) < 1 AS suspect FROM i WHERE total IS NOT NULL GROUP BY book")
def q_book_margin(t: Tables) -> DataFrame:
    return rounded(market.book_margins(t.sql(ODDS)), "mean_total", "margin_pct")


@query(_O + f""", m AS ({MATCH}), j AS (SELECT 1 / odds_1 / total AS p1, 1 / odds_x / total AS px, 1 / odds_2 / total AS p2, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS r FROM i JOIN m USING (match_id) WHERE odds_x IS NOT NULL),
 e AS (SELECT CASE WHEN p1 >= px AND p1 >= p2 THEN 'H' WHEN px >= p2 THEN 'D' ELSE 'A' END = r AS hit, pow(p1 - (r = 'H')::INT, 2) + pow(px - (r = 'D')::INT, 2) + pow(p2 - (r = 'A')::INT, 2) AS err FROM j)
 SELECT count(*) AS n, round(avg(hit::INT), 6) AS favourite_rate, round(avg(err), 6) AS brier_sum, round(avg(err) / 3, 6) AS brier_class FROM e""")
def q_market_benchmark(t: Tables) -> DataFrame:
    matches = t.sql(MATCH).withColumn("result", result_letter(F.col("home_goals"), F.col("away_goals")))
    return rounded(market.benchmark(t.sql(ODDS), matches), "favourite_rate", "brier_sum", "brier_class")


_S = f"WITH s AS ({SNAPSHOT}) "


def _prices(t: Tables) -> DataFrame:
    return t.sql(SNAPSHOT)


@query(_S + ", x AS (SELECT (max(odds) - min(odds)) / min(odds) * 100 AS v FROM s GROUP BY outcome_id HAVING count(*) > 1) SELECT (SELECT count(DISTINCT captured_at) FROM s) AS captures, count(*) AS outcomes, round(median(v), 6) AS median_pct, round(avg((v < 0.01)::INT) * 100, 6) AS unmoved_pct, count(*) FILTER (v > 10) AS volatile FROM x")
def q_line_movement(t: Tables) -> DataFrame:
    return rounded(market.line_movement(_prices(t)), "median_pct", "unmoved_pct")


@query(_S + "SELECT outcome_id, min_by(odds, captured_at) AS first_odds, max_by(odds, captured_at) AS last_odds FROM (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY outcome_id, captured_at) = 1) z GROUP BY outcome_id")
def q_first_last_price(t: Tables) -> DataFrame:
    once = _prices(t).groupBy("outcome_id", "captured_at").agg(F.count(F.lit(1)).alias("n"), F.first("odds").alias("odds")).where("n = 1")
    return market.first_last_price(once)


@query(_S + """, o AS (SELECT market, offer_id, count(*) AS outcomes, sum(1 / odds) AS total, bool_or(is_player) AS is_player FROM s GROUP BY market, offer_id HAVING count(*) >= 2 AND sum(1 / odds) > 1 AND sum(1 / odds) < 2)
 SELECT market, count(*) AS n_offers, round((median(total) - 1) * 100, 6) AS margin_pct, bool_or(is_player) AS is_player FROM o GROUP BY market HAVING count(*) >= 5""")
def q_offer_margin(t: Tables) -> DataFrame:
    return rounded(market.offer_margins(_prices(t).withColumn("captured_at", F.lit("2024")), least=5), "margin_pct")


_PACKS = f"SELECT event_id AS pack_id, '2024' AS captured_at, CAST(outcome_id AS VARCHAR(20)) || ',' || CAST((outcome_id + 7) % 160 AS VARCHAR(20)) || CASE WHEN event_id % 2 = 0 THEN ',' || CAST((outcome_id + 31) % 160 AS VARCHAR(20)) ELSE '' END AS legs, odds * 4 AS odds FROM ({SNAPSHOT}) q"
_LEG_PRICES = f"SELECT outcome_id, '2024' AS captured_at, max(odds) AS odds FROM ({SNAPSHOT}) q GROUP BY outcome_id HAVING avg(odds) < 3.35"
COSTS = f"""WITH p AS ({_PACKS}), l AS ({_LEG_PRICES}), x AS (SELECT pack_id, odds, unnest(string_split(legs, ','))::BIGINT AS leg FROM p),
 c AS (SELECT pack_id, max(x.odds) AS pack_odds, count(*) AS n_legs, product(l.odds) AS product, max(x.odds) / product(l.odds) AS ratio FROM x LEFT JOIN l ON leg = outcome_id GROUP BY pack_id HAVING count(*) = count(l.odds)) """


def _leg_prices(t: Tables) -> DataFrame:
    """Odds are summed as decimals, so that a mean of just 3.35 isn't below it in one order of rows and not in another."""
    total = F.sum(F.col("odds").cast("decimal(18,6)"))
    below = total < F.count("odds") * F.lit("3.35").cast("decimal(3,2)")
    rows = t.sql(SNAPSHOT).groupBy("outcome_id").agg(F.max("odds").alias("odds"), below.alias("__below"))
    return rows.where("__below").select("outcome_id", F.lit("2024").alias("captured_at"), "odds")


def costs(t: Tables) -> DataFrame:
    return market.combination_cost(t.sql(_PACKS), _leg_prices(t))


@query(COSTS + "SELECT pack_id, n_legs, pack_odds, round(product, 6) AS product, round(ratio, 6) AS ratio FROM c")
def q_combination_cost(t: Tables) -> DataFrame:
    return rounded(costs(t).drop("captured_at"), "product", "ratio")


@query(COSTS + "SELECT n_legs, count(*) AS n, round(median(ratio), 6) AS median_ratio, round(avg(ratio), 6) AS mean_ratio, round(avg((ratio < 0.99)::INT) * 100, 6) AS below_pct, round(avg((ratio > 1.01)::INT) * 100, 6) AS above_pct FROM c GROUP BY ROLLUP (n_legs)")
def q_combination_summary(t: Tables) -> DataFrame:
    return rounded(market.combination_summary(costs(t)), "median_ratio", "mean_ratio", "below_pct", "above_pct")


@query(_S + "SELECT count(*) AS lines, count(DISTINCT outcome_id) AS outcomes, count(DISTINCT market) AS markets, count(DISTINCT captured_at) AS captures, min(odds) AS least_odds, max(odds) AS most_odds FROM s")
def q_capture_summary(t: Tables) -> DataFrame:
    return market.capture_summary(_prices(t))


@query(_S + "SELECT market, count(*) AS n FROM s GROUP BY market ORDER BY n DESC, market LIMIT 12")
def q_top_markets(t: Tables) -> DataFrame:
    return market.top_markets(_prices(t))


@query(_S + "SELECT outcome_id, market, odds FROM s WHERE date_trunc('day', captured_at) = (SELECT max(date_trunc('day', captured_at)) FROM s)")
def q_latest_capture(t: Tables) -> DataFrame:
    return market.latest_capture(_prices(t).withColumn("day", F.date_trunc("day", "captured_at")), "day").select("outcome_id", "market", "odds")


_P = f"WITH p AS ({PRED}) "
_BRIER = "avg(pow(p1 - (y = 0)::INT, 2) + pow(px - (y = 1)::INT, 2) + pow(p2 - (y = 2)::INT, 2))"
_LOSS = "-avg(ln(CASE y WHEN 0 THEN p1 WHEN 1 THEN px ELSE p2 END))"
_HITS = "avg((CASE WHEN p1 >= px AND p1 >= p2 THEN 0 WHEN px >= p2 THEN 1 ELSE 2 END = y)::INT)"
_LONG = "c AS (SELECT league, 0 AS class, p1 AS p, (y = 0)::INT AS hit FROM p UNION ALL SELECT league, 1, px, (y = 1)::INT FROM p UNION ALL SELECT league, 2, p2, (y = 2)::INT FROM p) "


def _pred(t: Tables) -> DataFrame:
    return t.sql(PRED)


@query(_P + f", {_LONG}, b AS (SELECT league, class, least(floor(p * 10), 9) AS bin, count(*) AS n, abs(avg(hit) - avg(p)) AS gap FROM c GROUP BY 1, 2, 3), e AS (SELECT league, sum(n * gap) / sum(n) AS ece FROM b GROUP BY league) SELECT league, count(*) AS n, round({_BRIER}, 6) AS brier_sum, round({_BRIER} / 3, 6) AS brier_class, round({_LOSS}, 6) AS log_loss, round({_HITS}, 6) AS accuracy, round(any_value(ece), 6) AS ece FROM p JOIN e USING (league) GROUP BY league")
def q_evaluate(t: Tables) -> DataFrame:
    return rounded(metrics.evaluate(_pred(t), "league"), "brier_sum", "brier_class", "log_loss", "accuracy", "ece")


@query(_P + f", {_LONG} SELECT class, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(hit), 6) AS frequency FROM c GROUP BY 1, 2 HAVING count(*) >= 30")
def q_calibration_left(t: Tables) -> DataFrame:
    return rounded(metrics.calibration_left(_pred(t)), "mean_p", "frequency")


@query(_P + ", b AS (SELECT p1, (y = 0)::INT AS hit, " + " + ".join(f"(p1 > {i} / 10e0)::INT" for i in range(1, 10)) + " AS bin FROM p WHERE p1 > 0 AND p1 < 1) SELECT bin::INT AS bin, count(*) AS n, round(avg(p1), 6) AS mean_p, round(avg(hit), 6) AS frequency, round(avg(hit) - avg(p1), 6) AS gap FROM b GROUP BY 1 HAVING count(*) >= 30")
def q_calibration_right(t: Tables) -> DataFrame:
    rows = _pred(t).withColumn("hit", (F.col("y") == 0).cast("double"))
    return rounded(metrics.calibration_right(rows, "p1", "hit"), "mean_p", "frequency", "gap")


_BOTH = f"WITH p AS (SELECT 'model' AS model, p1, px, p2, y FROM ({PRED}) a UNION ALL SELECT 'market', q1, qx, q2, y FROM ({PRED}) b) "


def _both(t: Tables) -> DataFrame:
    own = _pred(t).select(F.lit("model").alias("model"), "p1", "px", "p2", "y")
    return own.unionByName(_pred(t).select(F.lit("market").alias("model"), F.col("q1").alias("p1"), F.col("qx").alias("px"), F.col("q2").alias("p2"), "y"))


@query(_BOTH + f", s AS (SELECT model, {_BRIER} / 3 AS b FROM p GROUP BY model) SELECT model, round(b, 6) AS brier_class, round(b - (SELECT b FROM s WHERE model = 'market'), 6) + 0e0 AS delta, b < (SELECT b FROM s WHERE model = 'market') AS better FROM s")
def q_compare(t: Tables) -> DataFrame:
    return rounded(metrics.compare(metrics.evaluate(_both(t), "model"), "market").select("model", "brier_class", "delta", "better"), "brier_class", "delta")


@query(_BOTH + f", s AS (SELECT model, {_LOSS} AS loss FROM p GROUP BY model) SELECT model, round(loss, 6) AS loss, round(exp(-loss) / sum(exp(-loss)) OVER (), 6) AS weight FROM s")
def q_weights(t: Tables) -> DataFrame:
    return rounded(metrics.likelihood_weights(_both(t)), "loss", "weight")


@query(_P + ", m AS (SELECT match_id, 0.4e0 * p1 + 0.6e0 * q1 AS a, 0.4e0 * px + 0.6e0 * qx AS b, 0.4e0 * p2 + 0.6e0 * q2 AS c FROM p) SELECT match_id, round(a / (a + b + c), 6) AS p1, round(b / (a + b + c), 6) AS px, round(c / (a + b + c), 6) AS p2 FROM m")
def q_ensemble(t: Tables) -> DataFrame:
    rows = _pred(t).select("match_id", *(F.col(f"p{s}").alias(f"a_p{s}") for s in "1x2"), *(F.col(f"q{s}").alias(f"b_p{s}") for s in "1x2"))
    return rounded(calibration.ensemble(rows, {"a": 0.4, "b": 0.6}).select("match_id", *metrics.P), *metrics.P)


@query(_P + ", x AS (SELECT p1 + px / 2 AS p, CASE y WHEN 0 THEN 1e0 WHEN 1 THEN 0.5e0 ELSE 0e0 END AS s FROM p) SELECT count(*) AS n, round(avg(pow(p - s, 2)), 6) AS brier, round(var_pop(s), 6) AS base_brier, round((1 - avg(pow(p - s, 2)) / var_pop(s)) * 100, 6) AS gain_pct, avg(pow(p - s, 2)) < 0.12 AS leak FROM x")
def q_elo_signal(t: Tables) -> DataFrame:
    rows = _pred(t).select((F.col("p1") + F.col("px") / 2).alias("p"), F.expr("CASE y WHEN 0 THEN 1D WHEN 1 THEN 0.5D ELSE 0D END").alias("y_score"))
    return rounded(metrics.elo_signal(rows), "brier", "base_brier", "gain_pct")


@query(_P + "SELECT round((avg(abs(p1 - q1)) + avg(abs(px - qx)) + avg(abs(p2 - q2))) / 3, 6) AS deviation FROM p")
def q_mean_deviation(t: Tables) -> DataFrame:
    return rounded(metrics.mean_deviation(_pred(t), ("q1", "qx", "q2")), "deviation")


@query(_P + "SELECT match_id, round(q1, 6) AS market_p1, round(ln(q1 / q2), 6) + 0e0 AS market_logit_1, round(ln(qx / q2), 6) + 0e0 AS market_logit_x, CASE WHEN q1 >= qx AND q1 >= q2 THEN 0e0 WHEN qx >= q2 THEN 1e0 ELSE 2e0 END AS market_favourite, round(-(q1 * ln(q1) + qx * ln(qx) + q2 * ln(q2)) / ln(3), 6) AS market_entropy FROM p")
def q_market_features(t: Tables) -> DataFrame:
    names = ("market_p1", "market_logit_1", "market_logit_x", "market_favourite", "market_entropy")
    return rounded(market_anchor.market_features(_pred(t)).select("match_id", *names), *names)


_OUT = "o AS (SELECT league, season, 0 AS outcome, p1 AS pm, q1 AS pk, odds_1 AS odds, (y = 0)::INT AS hit FROM p UNION ALL SELECT league, season, 1, px, qx, odds_x, (y = 1)::INT FROM p UNION ALL SELECT league, season, 2, p2, q2, odds_2, (y = 2)::INT FROM p) "


def _outcomes(t: Tables) -> DataFrame:
    return diagnosis.outcomes(_pred(t), "league", "season")


@query(_P + f", {_OUT} SELECT CASE WHEN pk <= 0.1 THEN 0 WHEN pk <= 0.2 THEN 1 WHEN pk <= 0.3 THEN 2 WHEN pk <= 0.45 THEN 3 WHEN pk <= 0.65 THEN 4 ELSE 5 END AS band, count(*) AS n, round(avg(pow(pm - hit, 2)), 6) AS brier_model, round(avg(pow(pk - hit, 2)), 6) AS brier_market FROM o GROUP BY 1 HAVING count(*) >= 100")
def q_band_brier(t: Tables) -> DataFrame:
    return rounded(diagnosis.band_brier(_outcomes(t)), "brier_model", "brier_market")


def _tests(values: str) -> str:
    return f", t AS (SELECT unnest([{values}]) AS threshold), d AS (SELECT unnest([1, -1]) AS direction), g AS (SELECT threshold, direction, count(*) FILTER (w) AS n, avg(pm) FILTER (w) AS a, avg(pk) FILTER (w) AS b, avg(hit) FILTER (w) AS c FROM (SELECT *, (pm - pk) * direction > threshold AS w FROM o, t, d) z GROUP BY 1, 2) "


_SHOWN = "round(a, 6) AS mean_model, round(b, 6) AS mean_market, round(c, 6) AS observed, round(abs(a - c), 6) AS error_model, round(abs(b - c), 6) AS error_market, CASE WHEN abs(a - c) < abs(b - c) THEN 'model' ELSE 'market' END AS nearer"
_MEANS = ("mean_model", "mean_market", "observed", "error_model", "error_market")


@query(_P + f", {_OUT}{_tests('0.03e0, 0.05e0, 0.08e0')} SELECT threshold, direction, n, {_SHOWN} FROM g WHERE n >= 100")
def q_discrepancy(t: Tables) -> DataFrame:
    return rounded(diagnosis.discrepancy(_outcomes(t)), *_MEANS)


@query(_P + f", {_OUT}{_tests('0.005e0, 0.01e0, 0.02e0, 0.05e0')}, k AS (SELECT threshold, direction, n, {_SHOWN} FROM g) SELECT threshold, direction, n, CASE WHEN n >= 12000 THEN mean_model END AS mean_model, CASE WHEN n >= 12000 THEN mean_market END AS mean_market, CASE WHEN n >= 12000 THEN observed END AS observed, CASE WHEN n >= 12000 THEN error_model END AS error_model, CASE WHEN n >= 12000 THEN error_market END AS error_market, CASE WHEN n >= 12000 THEN nearer END AS nearer FROM k")
def q_discrepancy_kept(t: Tables) -> DataFrame:
    return rounded(diagnosis.discrepancy(_outcomes(t), (0.005, 0.01, 0.02, 0.05), least=12000, keep_small=True), *_MEANS)


_BETS = _P + f", {_OUT}, b AS (SELECT *, pm - pk AS excess, pm * odds - 1 AS edge, hit * odds - 1 AS profit FROM o) "
_RULES = [(f"excess>={x:g}", f"excess >= {x}") for x in (0.0, 0.005, 0.01, 0.015, 0.02, 0.03)] + [(f"edge>={x:g}", f"edge >= {x}") for x in (0.0, 0.02, 0.05, 0.10)] + [(f"odds 1.5-4 excess>={x:g}", f"odds BETWEEN 1.5 AND 4.0 AND excess >= {x}") for x in (0.01, 0.015, 0.02)]
_BY_RULE = ", r AS (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, b.* FROM b WHERE {c.replace('>= 0.', '>= 0.').replace(' 0.0', ' 0.0')}" for n, c in _RULES) + ") "


def _bets(t: Tables) -> DataFrame:
    return diagnosis.bets(_outcomes(t))


@query(_BETS + _BY_RULE + ", s AS (SELECT rule, count(*) AS n, avg(profit) AS roi, stddev_samp(profit) / sqrt(count(*)) AS se, avg(odds) AS mean_odds, avg(hit) * 100 AS hit_pct, avg(edge) AS mean_edge FROM r GROUP BY rule) SELECT rule, n, round(roi, 6) AS roi, round(se, 6) AS se, round(mean_odds, 6) AS mean_odds, round(hit_pct, 6) AS hit_pct, round(mean_edge, 6) AS mean_edge, round(roi - 1.96 * se, 6) AS low, round(roi + 1.96 * se, 6) AS high, roi - 1.96 * se > 0 AS significant FROM s")
def q_bet_rules(t: Tables) -> DataFrame:
    return rounded(diagnosis.rule_summary(_bets(t)), "roi", "se", "mean_odds", "hit_pct", "mean_edge", "low", "high")


@query(_BETS + _BY_RULE + f""", s AS (SELECT rule, season, count(*) AS n, sum(profit) AS profit FROM r GROUP BY 1, 2), g AS (SELECT rule, sum(n) AS n, sum(profit) AS total, arg_max(season, struct_pack(a := profit, b := season)) AS best_season, arg_max(n, struct_pack(a := profit, b := season)) AS best_n, max(profit) AS best_profit FROM s GROUP BY rule),
 z AS (SELECT rule, avg(profit) / (stddev_samp(profit) / sqrt(count(*))) AS z FROM r GROUP BY rule), w AS (SELECT rule, sum(profit) AS largest FROM (SELECT * FROM r WHERE profit > 0 QUALIFY row_number() OVER (PARTITION BY rule ORDER BY profit DESC) <= 10) q GROUP BY rule)
 SELECT rule, n::BIGINT AS n, round(z, 6) AS z, round({diagnosis.two_sided(13)!r}::DOUBLE, 6) AS z_needed, z > {diagnosis.two_sided(13)!r} AS holds, best_season, round(CASE WHEN n - best_n > 30 THEN (total - best_profit) / (n - best_n) END, 6) AS roi_without_best, round(CASE WHEN total > 0 THEN largest / total END, 6) AS share_of_largest FROM g JOIN z USING (rule) LEFT JOIN w USING (rule) WHERE n >= 30""")
def q_robustness(t: Tables) -> DataFrame:
    return rounded(diagnosis.robustness(_bets(t)), "z", "z_needed", "roi_without_best", "share_of_largest")


_EVENTS = {
    "home_win": "home_goals > away_goals", "away_win": "home_goals < away_goals", "over_25": "home_goals + away_goals > 2.5", "btts": "home_goals > 0 AND away_goals > 0",
    "home_2": "home_goals >= 2", "home_shots_4": "home_shots >= 4", "away_shots_4": "away_shots >= 4",
}
_IND = f"WITH i AS (SELECT {', '.join(f'coalesce({c}, false) AS {n}' for n, c in _EVENTS.items())} FROM ({MATCH}) m) "
_PAIRS = [(a, b) for k, a in enumerate(sorted(_EVENTS)) for b in sorted(_EVENTS)[k + 1 :]]


def _indicators(t: Tables) -> DataFrame:
    return diagnosis.indicators(t.sql(MATCH), {n: F.expr(c) for n, c in _EVENTS.items()})


LIFT_PAIRS = _IND + ", l AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, avg({a}::INT) AS pa, avg({b}::INT) AS pb, avg(({a} AND {b})::INT) AS pab FROM i" for a, b in _PAIRS) + ") SELECT a, b, n, round(pa, 6) AS p_a, round(pb, 6) AS p_b, round(pab, 6) AS p_ab, round(pab / (pa * pb), 6) AS lift, round((pab - pa * pb) / sqrt(greatest(pab * (1 - pab), 1e-12) / n), 4) + 0e0 AS z, abs((pab - pa * pb) / sqrt(greatest(pab * (1 - pab), 1e-12) / n)) > 3 AS significant FROM l WHERE n >= 500 AND pa * pb > 0"


@query(LIFT_PAIRS)
def q_lift_pairs(t: Tables) -> DataFrame:
    return rounded(rounded(diagnosis.lifts(_indicators(t)), "p_a", "p_b", "p_ab", "lift"), "z", digits=4)


@query(_IND + ", l AS (SELECT count(*) AS n, count(*) FILTER (home_win AND over_25 AND home_2) AS hits, avg((home_win AND over_25 AND home_2)::INT) AS j, avg(home_win::INT) * avg(over_25::INT) * avg(home_2::INT) AS p FROM i) SELECT 'home_win+over_25+home_2' AS legs, n, hits, round(j, 6) AS p_joint, round(p, 6) AS p_product, round(j / p, 6) AS lift, round(1 / p / pow(1.05e0, 3), 6) AS offered_odds, round(1 / j, 6) AS fair_odds, round(j / p / pow(1.05e0, 3) - 1, 6) AS ev, hits >= 30 AS enough FROM l")
def q_combined(t: Tables) -> DataFrame:
    return rounded(diagnosis.combined(_indicators(t), ["home_win", "over_25", "home_2"]), "p_joint", "p_product", "lift", "offered_odds", "fair_odds", "ev")


@query(_P + f"SELECT league, count(*) AS n, round({_BRIER} / 3, 6) AS brier_model, round(({_BRIER} - avg(pow(q1 - (y = 0)::INT, 2) + pow(qx - (y = 1)::INT, 2) + pow(q2 - (y = 2)::INT, 2))) / 3, 6) AS difference FROM p GROUP BY league")
def q_by_league(t: Tables) -> DataFrame:
    own = metrics.evaluate(_pred(t), "league").select("league", "n", F.col("brier_class").alias("brier_model"))
    other = metrics.evaluate(_pred(t).select("league", F.col("q1").alias("p1"), F.col("qx").alias("px"), F.col("q2").alias("p2"), "y"), "league").select("league", F.col("brier_class").alias("b"))
    return rounded(own.join(other, "league").select("league", "n", "brier_model", (F.col("brier_model") - F.col("b")).alias("difference")), "brier_model", "difference")




_MILLI = "(CAST(floor(abs(value) * 10) AS BIGINT) + 990)"


def _responses(t: Tables) -> DataFrame:
    """Feed answers of ten events each: an offer per event with a team's and a player's outcome, a pack of nested legs."""
    outcome = lambda i, player: F.expr(f"named_struct('id', event_id * 2 + {i}, 'label', '1', 'participant', event_type, 'participantId', user_id, 'eventParticipantId', {player}, 'type', 'OT', 'line', event_id % 7 * 250, 'odds', {_MILLI} + {i} * 500, 'status', 'OPEN')")
    rows = t("events").withColumns({"a": outcome(0, "CAST(NULL AS BIGINT)"), "b": outcome(1, "user_id")})
    offer = F.expr("named_struct('id', event_id, 'criterion', named_struct('id', 1L, 'label', event_type), 'betOfferType', named_struct('name', 'Match'), 'outcomes', array(a, b))").cast(feed.OFFER)
    group = "named_struct('outcomes', array(named_struct('id', event_id + 1)), 'groups', array(named_struct('outcomes', array(named_struct('id', event_id), named_struct('id', event_id + 2)))))"
    pack = F.from_json(F.to_json(F.expr(f"named_struct('id', event_id, 'tags', array('t'), 'prePackSelections', array(named_struct('selectionId', user_id, 'label', array('l'), 'status', 'OPEN', 'combinations', array(named_struct('odds', named_struct('decimal', {_MILLI} * 2), 'groups', array({group}))))))")), feed.PACK.replace("`", ""))
    return rows.groupBy((F.floor(F.col("event_id") / 10)).alias("event_id")).agg(F.lit("L").alias("league"), F.collect_list(offer).alias("betOffers"), F.collect_list(pack).alias("prePacks"))


@query(f"WITH e AS (SELECT *, {_MILLI} AS m FROM events), o AS (SELECT event_id * 2 AS outcome_id, event_id AS offer_id, event_type AS market, false AS is_player, event_id % 7 * 250 / 1000e0 AS line, m / 1000e0 AS odds FROM e UNION ALL SELECT event_id * 2 + 1, event_id, event_type, true, event_id % 7 * 250 / 1000e0, (m + 500) / 1000e0 FROM e) SELECT outcome_id, offer_id, market, is_player, line, odds, round(1 / odds, 6) AS implied FROM o WHERE odds > 1")
def q_feed_prices(t: Tables) -> DataFrame:
    return feed.prices(_responses(t), F.lit("2024-05-01T10:00:00Z")).select("outcome_id", "offer_id", "market", "is_player", "line", "odds", "implied")


@query(f"WITH e AS (SELECT *, {_MILLI} AS m FROM events) SELECT event_id AS pack_id, user_id AS selection_id, 3 AS n_legs, (event_id + 1) || ',' || event_id || ',' || (event_id + 2) AS legs, m * 2 / 1000e0 AS odds, substr(sha256(CAST(floor(event_id / 10e0) AS BIGINT) || '|[' || event_id || ', ' || (event_id + 1) || ', ' || (event_id + 2) || ']'), 1, 16) AS pack_hash FROM e WHERE m * 2 > 1000")
def q_feed_packs(t: Tables) -> DataFrame:
    return feed.packs(_responses(t), F.lit("2024-05-01T10:00:00Z")).select("pack_id", "selection_id", "n_legs", "legs", "odds", "pack_hash")
