"""Where forecasts and markets differ, and what betting on that would have paid."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bands of the market's probability, right-closed.
BANDS = (0.0, 0.1, 0.2, 0.3, 0.45, 0.65, 1.0)


def outcomes(rows: DataFrame, *keep: str) -> DataFrame:
    """A row per match and outcome: the model's and the market's probability, odds if given, and whether it happened."""
    odds = all(f"odds_{s}" in rows.columns for s in ("1", "x", "2"))
    one = lambda k, s: F.struct(F.lit(k).alias("outcome"), F.col(f"p{s}").alias("p_model"), F.col(f"q{s}").alias("p_market"), (F.col(f"odds_{s}") if odds else F.lit(None).cast("double")).alias("odds"), (F.col("y") == k).cast("double").alias("hit"))
    return rows.select(*keep, F.explode(F.array(one(0, "1"), one(1, "x"), one(2, "2"))).alias("o")).select(*keep, "o.*")


def band(p: Column) -> Column:
    """The index of the band that p falls into; null outside (0, 1]."""
    found = F.when((p <= BANDS[0]) | (p > BANDS[-1]), F.lit(None).cast("int"))
    for i, high in enumerate(BANDS[1:]):
        found = found.when(p <= high, F.lit(i))
    return found


def band_brier(rows: DataFrame, least: int = 100) -> DataFrame:
    """Squared errors of both by band of the market's probability."""
    at = rows.withColumn("band", band(F.col("p_market"))).where("band is not null")
    return at.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p_model") - F.col("hit"), 2)).alias("brier_model"), F.avg(F.pow(F.col("p_market") - F.col("hit"), 2)).alias("brier_market")).where(F.col("n") >= least)


def discrepancy(rows: DataFrame, thresholds: tuple[float, ...] = (0.03, 0.05, 0.08), least: int = 100, keep_small: bool = False) -> DataFrame:
    """Outcomes that the model rates higher (direction 1) or lower (-1) than the market by more than a threshold: means, and who was nearer.

    keep_small keeps a row, with its count alone, for thresholds with too few outcomes."""
    excess = F.col("p_model") - F.col("p_market")
    tests = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.lit(d).alias("direction")) for t in thresholds for d in (1, -1)))).alias("t")
    met = rows.select("p_model", "p_market", "hit", tests).select("p_model", "p_market", "hit", "t.*")
    inside = excess * F.col("direction") > F.col("threshold")
    pick = lambda c: F.avg(F.when(inside, c))
    found = met.groupBy("threshold", "direction").agg(F.count(F.when(inside, 1)).alias("n"), pick(F.col("p_model")).alias("mean_model"), pick(F.col("p_market")).alias("mean_market"), pick(F.col("hit")).alias("observed"))
    found = found.withColumns({"error_model": F.abs(F.col("mean_model") - F.col("observed")), "error_market": F.abs(F.col("mean_market") - F.col("observed"))})
    found = found.withColumn("nearer", F.when(F.col("error_model") < F.col("error_market"), "model").otherwise("market"))
    if not keep_small:
        return found.where(F.col("n") >= least)
    values = ("mean_model", "mean_market", "observed", "error_model", "error_market", "nearer")
    return found.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in values})


def bets(rows: DataFrame) -> DataFrame:
    """Outcomes with odds as unit bets: excess over the market, edge and return."""
    return rows.where("odds is not null").withColumns({"excess": F.col("p_model") - F.col("p_market"), "edge": F.col("p_model") * F.col("odds") - 1, "profit": F.col("hit") * F.col("odds") - 1})


def rules() -> list[tuple[str, Column]]:
    """The 13 betting rules."""
    found = [(f"excess>={t:g}", F.col("excess") >= t) for t in (0.0, 0.005, 0.01, 0.015, 0.02, 0.03)]
    found += [(f"edge>={t:g}", F.col("edge") >= t) for t in (0.0, 0.02, 0.05, 0.10)]
    return found + [(f"odds 1.5-4 excess>={t:g}", F.col("odds").between(1.5, 4.0) & (F.col("excess") >= t)) for t in (0.01, 0.015, 0.02)]


def by_rule(rows: DataFrame) -> DataFrame:
    """A row per bet and rule that it meets."""
    met = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in rules())), lambda x: x.isNotNull())
    return rows.withColumn("rule", F.explode(met))


def rule_summary(rows: DataFrame) -> DataFrame:
    """Per rule: bets, return on investment with its standard error and 95 % interval, odds, hits, edge."""
    mean, error = F.avg("profit"), F.stddev_samp("profit") / F.sqrt(F.count(F.lit(1)))
    found = by_rule(rows).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), mean.alias("roi"), error.alias("se"), F.avg("odds").alias("mean_odds"), (F.avg("hit") * 100).alias("hit_pct"), F.avg("edge").alias("mean_edge"))
    return found.withColumns({"low": F.col("roi") - 1.96 * F.col("se"), "high": F.col("roi") + 1.96 * F.col("se")}).withColumn("significant", F.col("low") > 0)


def two_sided(tests: int, level: float = 0.05) -> float:
    """The z that one of so many tests must reach (Bonferroni)."""
    return NormalDist().inv_cdf(1 - level / tests / 2)


def robustness(rows: DataFrame, season: str = "season", tests: int = 13, least: int = 30, top: int = 10) -> DataFrame:
    """Per rule with enough bets: z against the corrected bound, best season and the return without it, share of the profit in the largest wins."""
    met = by_rule(rows)
    seasons = met.groupBy("rule", season).agg(F.count(F.lit(1)).alias("n"), F.sum("profit").alias("profit"))
    largest = met.where("profit > 0").withColumn("__rn", F.row_number().over(Window.partitionBy("rule").orderBy(F.col("profit").desc()))).where(F.col("__rn") <= top).groupBy("rule").agg(F.sum("profit").alias("largest"))
    best = seasons.groupBy("rule").agg(F.max_by(season, F.struct("profit", season)).alias("best_season"), F.max_by("n", F.struct("profit", season)).alias("best_n"), F.max("profit").alias("best_profit"), F.sum("n").alias("n"), F.sum("profit").alias("total"))
    spread = met.groupBy("rule").agg((F.avg("profit") / (F.stddev_samp("profit") / F.sqrt(F.count(F.lit(1))))).alias("z"))
    found = best.where(F.col("n") >= least).join(spread, "rule").join(largest, "rule", "left")
    rest = F.col("n") - F.col("best_n")
    return found.select("rule", "n", "z", F.lit(two_sided(tests)).alias("z_needed"), (F.col("z") > two_sided(tests)).alias("holds"), "best_season", F.when(rest > least, (F.col("total") - F.col("best_profit")) / rest).alias("roi_without_best"), F.when(F.col("total") > 0, F.col("largest") / F.col("total")).alias("share_of_largest"))


def indicators(matches: DataFrame, events: dict[str, Column]) -> DataFrame:
    """Boolean columns of events; null counts as false."""
    return matches.select(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in events.items()))


def lifts(rows: DataFrame, least: int = 500) -> DataFrame:
    """Per pair of boolean columns: marginals, joint frequency, lift and z.  All pairs come from one aggregation."""
    names = sorted(rows.columns)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    num = lambda c: F.avg(c.cast("double"))
    one = rows.agg(F.count(F.lit(1)).alias("n"), *(num(F.col(a)).alias(f"m_{a}") for a in names), *(num(F.col(a) & F.col(b)).alias(f"j_{a}_{b}") for a, b in pairs))
    long = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"m_{a}").alias("p_a"), F.col(f"m_{b}").alias("p_b"), F.col(f"j_{a}_{b}").alias("p_ab")) for a, b in pairs))).alias("x")
    found = one.select("n", long).select("n", "x.*").where((F.col("n") >= least) & (F.col("p_a") * F.col("p_b") > 0))
    error = F.sqrt(F.greatest(F.col("p_ab") * (1 - F.col("p_ab")), F.lit(1e-12)) / F.col("n"))
    found = found.withColumns({"lift": F.col("p_ab") / (F.col("p_a") * F.col("p_b")), "z": (F.col("p_ab") - F.col("p_a") * F.col("p_b")) / error})
    return found.withColumn("significant", F.abs("z") > 3)


def extreme_lifts(found: DataFrame, top: int = 12, bottom: int = 6) -> DataFrame:
    """Of lifts' rows those with the largest lifts and those with the smallest (side `top` or `bottom`); equal ones go by the names of their columns."""
    first = found.orderBy(F.col("lift").desc(), "a", "b").limit(top).withColumn("side", F.lit("top"))
    last = found.orderBy("lift", "a", "b").limit(bottom).withColumn("side", F.lit("bottom"))
    return first.unionByName(last)


def combined(rows: DataFrame, legs: list[str], margin: float = 0.05, enough: int = 30) -> DataFrame:
    """One row for a combination of boolean columns: joint frequency against the product, fair and offered odds, expected value."""
    both = F.lit(True)
    for leg in legs:
        both = both & F.col(leg)
    product = F.lit(1.0)
    for leg in legs:
        product = product * F.avg(F.col(leg).cast("double"))
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(both, 1)).alias("hits"), F.avg(both.cast("double")).alias("p_joint"), product.alias("p_product"))
    offered = F.try_divide(F.lit(1.0), F.col("p_product")) / (1 + margin) ** len(legs)
    return one.select(F.lit("+".join(legs)).alias("legs"), "n", "hits", "p_joint", "p_product", F.try_divide("p_joint", "p_product").alias("lift"), offered.alias("offered_odds"), F.try_divide(F.lit(1.0), F.col("p_joint")).alias("fair_odds"), (F.col("p_joint") * offered - 1).alias("ev"), (F.col("hits") >= enough).alias("enough"))
