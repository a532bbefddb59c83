"""Queries over matches: validity, labels, features, folds, names, scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import odds, text
from touchline.operators import elo, entity, features, folds, matches, scorers
from touchline.plans.base import longs, query, rounded
from touchline.plans.fixtures import LOG, MATCH, PARTLY, Tables

_M = f"WITH m AS ({MATCH}) "
_P = f"WITH m AS ({PARTLY}) "
_FAULTY = f"""SELECT match_id, CASE WHEN match_id % 31 = 1 THEN NULL ELSE home END AS home, CASE WHEN match_id % 37 = 2 THEN home ELSE away END AS away,
 CASE WHEN match_id % 41 = 3 THEN '2024-99-01' ELSE replace(substr(CAST(kickoff AS VARCHAR(30)), 1, 10), ' ', '') || 'T15:00:00Z' END AS kickoff,
 CASE WHEN match_id % 43 = 4 THEN -1 ELSE home_goals END AS home_goals, away_goals, CASE WHEN match_id % 47 = 5 THEN 'H' WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS result FROM ({MATCH}) q"""


@query(f"""WITH m AS ({_FAULTY}), r AS (SELECT CASE WHEN match_id IS NULL THEN 'no match_id' WHEN home IS NULL OR away IS NULL THEN 'empty team' WHEN home = away THEN 'team against itself'
 WHEN try_strptime(substr(kickoff, 1, 19), '%Y-%m-%dT%H:%M:%S') IS NULL THEN 'bad kickoff' WHEN home_goals < 0 OR away_goals < 0 THEN 'negative goals'
 WHEN result <> CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END THEN 'result against score' END AS reason FROM m) SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def q_match_valid(t: Tables) -> DataFrame:
    return t.sql(_FAULTY).groupBy(matches.invalid_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_TWICE = f"SELECT match_id % 5000 AS k, match_id AS seq, home, away FROM ({MATCH}) q"


@query(f"SELECT k, seq, home, away FROM ({_TWICE}) d QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1")
def q_match_dedupe(t: Tables) -> DataFrame:
    return matches.deduplicated(t.sql(_TWICE), ["k"], "seq")


@query(_P + """SELECT match_id, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' WHEN home_goals = away_goals THEN 'D' END AS y_result, (home_goals + away_goals)::INT AS y_total,
 (home_goals + away_goals > 2.5)::INT AS y_over25, (home_goals > 0 AND away_goals > 0)::INT AS y_btts, CASE WHEN home_goals > away_goals THEN 1e0 WHEN home_goals = away_goals THEN 0.5e0 WHEN home_goals < away_goals THEN 0e0 END AS y_home_score FROM m""")
def q_labels(t: Tables) -> DataFrame:
    rows = t.sql(PARTLY)
    return rows.withColumns(matches.labels(F.col("home_goals"), F.col("away_goals"))).select("match_id", "y_result", "y_total", "y_over25", F.when(F.col("home_goals").isNotNull() & F.col("away_goals").isNotNull(), F.col("y_btts")).otherwise(F.col("y_btts")).alias("y_btts"), "y_home_score")


@query(_M + """SELECT match_id, home_goals_ht AS home_first, away_goals_ht AS away_first, (home_goals - home_goals_ht)::INT AS home_second, (away_goals - away_goals_ht)::INT AS away_second FROM m WHERE home_goals >= home_goals_ht AND away_goals >= away_goals_ht""")
def q_halves(t: Tables) -> DataFrame:
    rows = t.sql(MATCH)
    first = matches.first_half(rows).select("match_id", F.col("home_goals").alias("home_first"), F.col("away_goals").alias("away_first"))
    second = matches.second_half(rows).select("match_id", F.col("home_goals").alias("home_second"), F.col("away_goals").alias("away_second"))
    return first.join(second, "match_id")


@query(_P + "SELECT 'home_goals' AS \"column\", round(count(home_goals)::DOUBLE / count(*), 6) AS share FROM m UNION ALL SELECT 'home_shots', round(count(home_shots)::DOUBLE / count(*), 6) FROM m UNION ALL SELECT 'away_goals', round(count(away_goals)::DOUBLE / count(*), 6) FROM m")
def q_coverage(t: Tables) -> DataFrame:
    return rounded(matches.coverage(t.sql(PARTLY), ["home_goals", "home_shots", "away_goals"]), "share")


@query(_M + "SELECT home AS team FROM m UNION SELECT away FROM m")
def q_teams_union(t: Tables) -> DataFrame:
    return matches.teams(t.sql(MATCH))


_LOG = f"WITH l AS ({LOG}) "
_W = "OVER (PARTITION BY team ORDER BY kickoff, match_id ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"


def _features(t: Tables) -> DataFrame:
    return features.team_features(features.team_log(t.sql(MATCH)))


@query(_LOG + f"SELECT match_id, at_home, round(avg(gf) {_W.format(5)}, 6) AS gf_5, round(avg(ga) {_W.format(5)}, 6) AS ga_5, round(avg(gf) {_W.format(10)}, 6) AS gf_10, count(*) {_W.format('UNBOUNDED')} AS prior FROM l")
def q_roll_goals(t: Tables) -> DataFrame:
    return rounded(_features(t).select("match_id", "at_home", "gf_5", "ga_5", "gf_10", "prior"), "gf_5", "ga_5", "gf_10")


@query(_LOG + f", x AS (SELECT match_id, at_home, list_reverse(list(sf) FILTER (sf IS NOT NULL) {_W.format('UNBOUNDED')})[1:10][1:5] AS v FROM l) SELECT match_id, at_home, round(CASE WHEN len(v) > 0 THEN list_avg(v) END, 6) AS sf_5 FROM x")
def q_roll_nonnull(t: Tables) -> DataFrame:
    return rounded(_features(t).select("match_id", "at_home", "sf_5"), "sf_5")


_LAGS = [f"lag(pts, {i}) OVER w" for i in range(1, 11)]


@query(f"""WITH l AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS pts FROM ({LOG}) z),
 x AS (SELECT match_id, at_home, {" + ".join(f"coalesce({c}, 0) * pow(0.85e0, {i})" for i, c in enumerate(_LAGS))} AS s, {" + ".join(f"CASE WHEN {c} IS NULL THEN 0e0 ELSE pow(0.85e0, {i}) END" for i, c in enumerate(_LAGS))} AS d FROM l WINDOW w AS (PARTITION BY team ORDER BY kickoff, match_id))
 SELECT match_id, at_home, round(CASE WHEN d > 0 THEN s / d END, 6) AS form FROM x""")
def q_ewm_form(t: Tables) -> DataFrame:
    return rounded(_features(t).select("match_id", "at_home", "form"), "form")


_LW = "OVER (PARTITION BY league ORDER BY kickoff, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_PLAYED = "CASE WHEN home_goals IS NOT NULL AND away_goals IS NOT NULL THEN {} END"


@query(_P + f"SELECT match_id, round(coalesce(avg({_PLAYED.format('home_goals')}) {_LW}, 1.45e0), 6) AS league_home, round(coalesce(avg({_PLAYED.format('away_goals')}) {_LW}, 1.15e0), 6) AS league_away, count({_PLAYED.format('1')}) {_LW} AS league_prior FROM m")
def q_cum_league(t: Tables) -> DataFrame:
    return rounded(features.league_means(t.sql(PARTLY)).select("match_id", "league_home", "league_away", "league_prior"), "league_home", "league_away")


@query(_LOG + f", x AS (SELECT match_id, at_home, date_diff('second', lag(kickoff) OVER (PARTITION BY team ORDER BY kickoff, match_id), kickoff) / 86400e0 AS rest FROM l) SELECT match_id, at_home, round(rest, 6) AS rest_days, coalesce((rest < 4)::INT, 0) AS congested FROM x")
def q_rest_days(t: Tables) -> DataFrame:
    return rounded(_features(t).select("match_id", "at_home", "rest_days", "congested"), "rest_days")


@query(f"""WITH l AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS pts FROM ({LOG}) z)
 SELECT match_id, at_home, round(avg(pts) OVER (PARTITION BY team, at_home ORDER BY kickoff, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS side_ppm FROM l""")
def q_venue_ppm(t: Tables) -> DataFrame:
    return rounded(_features(t).select("match_id", "at_home", "side_ppm"), "side_ppm")


@query(f"""WITH m AS ({MATCH}), l AS ({LOG}), g AS (SELECT match_id, at_home, avg(gf) {_W.format(10)} AS gf10, avg(ga) {_W.format(10)} AS ga10, count(*) {_W.format('UNBOUNDED')} AS prior FROM l),
 c AS (SELECT match_id, coalesce(avg(home_goals) {_LW}, 1.45e0) AS lh, coalesce(avg(away_goals) {_LW}, 1.15e0) AS la FROM m)
 SELECT c.match_id, round(h.gf10 / nullif(lh, 0), 6) AS home_attack, round(h.ga10 / nullif(la, 0), 6) AS home_defence, round(a.gf10 / nullif(la, 0), 6) AS away_attack, round(a.ga10 / nullif(lh, 0), 6) AS away_defence, (least(h.prior, a.prior) >= 5)::INT AS reliable
 FROM c JOIN g h ON h.match_id = c.match_id AND h.at_home = 1 JOIN g a ON a.match_id = c.match_id AND a.at_home = 0""")
def q_strength(t: Tables) -> DataFrame:
    names = ("home_attack", "home_defence", "away_attack", "away_defence")
    return rounded(features.match_features(t.sql(MATCH)).select("match_id", *names, "reliable"), *names)


@query()
def q_match_features(t: Tables) -> DataFrame:
    return features.match_features(t.sql(PARTLY)).join(elo.ratings(t.sql(PARTLY)), "match_id")


#: A step rates the next match of each league, whose ratings are a list by team; the tables' teams never leave their league.
_ELO = f"""WITH RECURSIVE m AS (SELECT league, match_id, home - league * 12 + 1 AS h, away - league * 12 + 1 AS a, home_goals AS x, away_goals AS y, row_number() OVER (PARTITION BY league ORDER BY kickoff, match_id) AS r FROM ({MATCH}) q),
 s(league, r, match_id, eh, ea, expected, elo) AS (SELECT DISTINCT league, 0::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, list_transform(range(12), lambda i: 1500e0) FROM m
 UNION ALL SELECT league, r, match_id, eh, ea, expected, list_transform(elo, lambda v, i: v + CASE i WHEN h THEN move WHEN a THEN -move ELSE 0 END)
 FROM (SELECT *, 20 * (1 + ln(1 + abs(x - y))) * (CASE WHEN x > y THEN 1 WHEN x = y THEN 0.5e0 ELSE 0 END - expected) AS move
 FROM (SELECT *, 1 / (1 + pow(10e0, -(eh + 60 - ea) / 400)) AS expected FROM (SELECT m.*, s.elo, s.elo[m.h] AS eh, s.elo[m.a] AS ea FROM s JOIN m ON m.league = s.league AND m.r = s.r + 1) b) c) d)
 SELECT match_id, round(eh, 6) AS home_elo, round(ea, 6) AS away_elo, round(expected, 6) AS home_expectation FROM s WHERE r > 0"""


@query(_ELO)
def q_elo(t: Tables) -> DataFrame:
    return rounded(elo.ratings(t.sql(MATCH)), "home_elo", "away_elo", "home_expectation")


_FOLDS = f"""WITH m AS ({MATCH}), s AS (SELECT season AS fold, min(kickoff) AS cut FROM m GROUP BY 1 QUALIFY row_number() OVER (ORDER BY season) > 3),
 p AS (SELECT fold, match_id, kickoff, count(*) OVER (PARTITION BY fold) AS n, row_number() OVER (PARTITION BY fold ORDER BY kickoff DESC, match_id DESC) AS r FROM m JOIN s ON kickoff < cut),
 f AS (SELECT fold, CASE WHEN r <= greatest(200, floor(n * 0.15e0)) THEN 'val' ELSE 'train' END AS split, match_id, kickoff FROM p WHERE n >= 500
  UNION ALL SELECT season, 'test', match_id, kickoff FROM m WHERE season IN (SELECT fold FROM p WHERE n >= 500)) """


@query(_FOLDS + "SELECT fold, split, match_id FROM f")
def q_folds(t: Tables) -> DataFrame:
    return folds.season_folds(t.sql(MATCH)).select("fold", "split", "match_id")


@query(_FOLDS + """, e AS (SELECT fold, max(kickoff) FILTER (split = 'train') AS a, min(kickoff) FILTER (split = 'val') AS b0, max(kickoff) FILTER (split = 'val') AS b1, min(kickoff) FILTER (split = 'test') AS c FROM f GROUP BY fold)
 SELECT fold, coalesce(a > b0, false) AS train_after_val, coalesce(b1 >= c, false) AS val_in_test, coalesce(a >= c, false) AS train_in_test, (SELECT count(*) FROM f x WHERE x.fold = e.fold AND split = 'test' AND match_id IN (SELECT match_id FROM f y WHERE y.fold = e.fold AND split <> 'test')) AS shared FROM e""")
def q_fold_violations(t: Tables) -> DataFrame:
    return folds.violations(folds.season_folds(t.sql(MATCH)))


@query(_M + "SELECT match_id, league FROM m QUALIFY row_number() OVER (PARTITION BY league ORDER BY kickoff DESC, match_id DESC) <= 2000")
def q_last_per_league(t: Tables) -> DataFrame:
    return folds.last_per(t.sql(MATCH), "league", 2000).select("match_id", "league")


_SLUGS = "SELECT lower(replace(s_name, '#', '_')) AS slug FROM {supplier}"
_NAMES = """SELECT CASE s_suppkey % 4 WHEN 0 THEN replace(s_name, '#', ' ') WHEN 1 THEN 'FC ' || replace(s_name, '#', ' ') WHEN 2 THEN replace(s_name, '#', ' ') || ' Real' ELSE 'Zzz ' || CAST(s_suppkey AS VARCHAR(20)) || 'q' END AS name FROM {supplier}"""


@query(f"""WITH n AS (SELECT DISTINCT name FROM ({_NAMES}) q), s AS (SELECT DISTINCT slug FROM ({_SLUGS}) q)
 SELECT name, CASE WHEN name LIKE 'Zzz%' THEN NULL ELSE (SELECT min(slug) FROM s WHERE slug = lower(replace(replace(replace(name, 'FC ', ''), ' Real', ''), ' ', '_'))) END AS slug,
 CASE WHEN name LIKE 'FC %' THEN 'nucleo' WHEN name LIKE '% Real' THEN 'subconjunto' WHEN name LIKE 'Zzz%' THEN 'sin_coincidencia' ELSE 'exacto' END AS method FROM n""")
def q_entity(t: Tables) -> DataFrame:
    names = t.sql(f"SELECT name FROM ({_NAMES}) q")
    slugs = t.sql(f"SELECT slug FROM ({_SLUGS}) q")
    real = entity.resolve(names.where("name not like '% Real'"), slugs, closest=False)
    within = entity.resolve(names.where("name like '% Real'"), slugs, closest=False)
    return real.unionByName(within).select("name", "slug", "method")


_EVENTS = f"SELECT match_id AS event_id, CAST(league AS VARCHAR(10)) AS league, CAST(kickoff AS DATE) AS day, 'Team ' || CAST(home AS VARCHAR(10)) AS home_name FROM ({MATCH}) q"
_RESULTS = f"SELECT match_id AS result_id, CAST(league AS VARCHAR(10)) AS league, CAST(kickoff AS DATE) AS day, 'TEAM ' || CAST(home AS VARCHAR(10)) || '.' AS home_name, home_goals, away_goals FROM ({MATCH}) q"


@query(f"""WITH e AS ({_EVENTS}), r AS ({_RESULTS}) SELECT event_id, result_id, home_goals, away_goals FROM e JOIN r ON e.league = r.league AND r.day BETWEEN e.day AND e.day + 1 AND lower(e.home_name) = lower(replace(r.home_name, '.', ''))
 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY r.day, result_id) = 1""")
def q_result_band(t: Tables) -> DataFrame:
    return entity.results_for(t.sql(_EVENTS), t.sql(_RESULTS)).select("event_id", "result_id", "home_goals", "away_goals")




def _scored(season: int) -> str:
    """Goals and matches of a season's players; some play in one of two seasons only."""
    return f"SELECT player, CAST(sum(home_goals) AS BIGINT) AS goals, count(*) AS played FROM (SELECT match_id % 499 + season % 2 * 60 AS player, home_goals FROM ({MATCH}) q WHERE season = {season}) r GROUP BY player"


_RATES = f"""WITH a AS ({_scored(1998)}), b AS ({_scored(1997)}), j AS (SELECT coalesce(a.player, b.player) AS player, a.goals, a.played, b.goals AS gb, b.played AS pb, coalesce(b.played >= 5, false) AS ok FROM a FULL JOIN b ON a.player = b.player),
 r AS (SELECT player, coalesce(goals, 0) AS goals, coalesce(played, 0) AS played, coalesce(pb, 0) AS played_before, CASE WHEN ok THEN gb / pb::DOUBLE END AS rate_before,
  CASE WHEN played IS NULL THEN gb / pb::DOUBLE WHEN ok THEN (goals + 10e0 * (gb / pb::DOUBLE)) / (played + 10e0) ELSE goals::DOUBLE / played END AS rate, CASE WHEN played IS NULL THEN 10e0 WHEN ok THEN played + 10e0 ELSE played::DOUBLE END AS stands_on FROM j WHERE played IS NOT NULL OR ok) """


def _rates(t: Tables) -> DataFrame:
    return scorers.shrunk_rates(t.sql(_scored(1998)), t.sql(_scored(1997)))


@query(_RATES + "SELECT player, goals, played, played_before, round(rate_before, 6) AS rate_before, round(rate, 6) AS rate, stands_on, played + played_before >= 8 AS reliable FROM r")
def q_shrinkage(t: Tables) -> DataFrame:
    return longs(rounded(_rates(t), "rate_before", "rate"), "goals", "played", "played_before")


@query(_RATES + f""", x AS (SELECT match_id, match_id % 499 AS player, 0.5e0 + match_id % 20 / 1e1 AS team_goals FROM ({MATCH}) q),
 l AS (SELECT match_id, x.player, greatest(rate * team_goals / 1.35e0, 1e-6) AS lam FROM x JOIN r ON x.player = r.player WHERE played + played_before >= 8)
 SELECT match_id, player, round(1 - exp(-lam), 6) AS p1, round(1 - exp(-lam) - exp(-lam) * lam, 6) AS p2, round(1 - exp(-lam) - exp(-lam) * lam - exp(-lam) * lam * lam / 2, 6) AS p3 FROM l""")
def q_scorer_chances(t: Tables) -> DataFrame:
    rows = t.sql(f"SELECT match_id, match_id % 499 AS player, 0.5e0 + match_id % 20 / 1e1 AS team_goals FROM ({MATCH}) q")
    return rounded(scorers.scoring_chances(_rates(t), rows).select("match_id", "player", "p1", "p2", "p3"), "p1", "p2", "p3")


_CORNERS = f"SELECT league, home_shots AS home_corners, away_shots AS away_corners FROM ({MATCH}) q"


@query(f"SELECT CASE WHEN count(home_corners + away_corners) >= 30 THEN round(avg(home_corners + away_corners), 6) ELSE 10.2 END AS mean_corners FROM ({_CORNERS}) q")
def q_mean_corners(t: Tables) -> DataFrame:
    return rounded(matches.mean_corners(t.sql(_CORNERS)), "mean_corners")


@query("SELECT o_orderkey AS id, y || '-' || lpad(((y + 1) % 100)::VARCHAR, 2, '0') AS season FROM (SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS y FROM orders) q")
def q_season_label(t: Tables) -> DataFrame:
    return t("orders").select(F.col("o_orderkey").alias("id"), text.season_label(text.season_start(F.col("o_orderdate"))).alias("season"))


@query(f"SELECT match_id, round(1 / (1 + pow(10e0, -(1500 + match_id % 400 + 60 - (1500 + match_id % 331)) / 400e0)), 6) AS expectation, round(pow(0.5e0, match_id % 1000 / 365e0), 6) AS weight FROM ({MATCH}) q")
def q_expectation(t: Tables) -> DataFrame:
    rows = t.sql(MATCH).select("match_id", odds.elo_expectation(1500.0 + F.col("match_id") % 400, 1500.0 + F.col("match_id") % 331).alias("expectation"), odds.time_weight(F.col("match_id") % 1000).alias("weight"))
    return rounded(rows, "expectation", "weight")
