"""Bookmakers' odds: margins, benchmarks, movement of lines, what combining costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.odds import implied, overround
from touchline.operators.medians import medians


def with_implied(odds: DataFrame) -> DataFrame:
    """odds (odds_1, odds_x, odds_2) with total, p1, px and p2."""
    rows = odds.withColumn("total", overround(F.col("odds_1"), F.col("odds_x"), F.col("odds_2")))
    return rows.withColumns({f"p{s}": implied(F.col(f"odds_{s}"), F.col("total")) for s in ("1", "x", "2")})


def closing_probabilities(matches: DataFrame, odds: DataFrame, book: str, order: str = "kickoff") -> DataFrame:
    """matches with p1, px, p2 of a bookmaker's closing odds; of several rows for a match the last counts; null without all three."""
    values = ("p1", "px", "p2")
    quotes = with_implied(odds.where((F.col("book") == book) & (F.col("odds_1") > 1) & (F.col("odds_x") > 1) & (F.col("odds_2") > 1)))
    last = quotes.groupBy("match_id").agg(F.max_by(F.struct(*values), order).alias("q"))
    return matches.join(last, "match_id", "left").select(*matches.columns, *(F.col(f"q.{v}").alias(v) for v in values))


def with_season(odds: DataFrame, matches: DataFrame) -> DataFrame:
    """odds with the season of their match (match_id, season); odds without a match drop out."""
    return odds.join(matches.select("match_id", "season"), "match_id").select(*odds.columns, "season")


def book_margins(odds: DataFrame) -> DataFrame:
    """Per bookmaker: lines, mean overround, margin in percent, and whether the mean is below 1."""
    rows = with_implied(odds).where("total is not null and book is not null")
    return rows.groupBy("book").agg(F.count(F.lit(1)).alias("n"), F.avg("total").alias("mean_total"), ((F.avg("total") - 1) * 100).alias("margin_pct"), (F.avg("total") < 1).alias("suspect"))


def favourite(p1: Column, px: Column, p2: Column) -> Column:
    """The likeliest of H, D and A, the first of equal ones."""
    return F.when((p1 >= px) & (p1 >= p2), "H").when(px >= p2, "D").otherwise("A")


def squared_error(p1: Column, px: Column, p2: Column, result: Column) -> Column:
    """The sum over the three outcomes of (probability - outcome) squared."""
    hit = lambda letter: (result == letter).cast("double")
    return F.pow(p1 - hit("H"), 2) + F.pow(px - hit("D"), 2) + F.pow(p2 - hit("A"), 2)


def benchmark(odds: DataFrame, matches: DataFrame) -> DataFrame:
    """How well implied probabilities do on played matches (match_id, result): hit rate of favourites, Brier score."""
    rows = with_implied(odds).join(matches.select("match_id", "result"), "match_id").where("p1 is not null and px is not null and p2 is not null and result is not null")
    p = (F.col("p1"), F.col("px"), F.col("p2"))
    error = squared_error(*p, F.col("result"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((favourite(*p) == F.col("result")).cast("double")).alias("favourite_rate"), F.avg(error).alias("brier_sum"), (F.avg(error) / 3).alias("brier_class"))


def latest_capture(rows: DataFrame, column: str = "captured_at") -> DataFrame:
    """The rows of the last capture."""
    return rows.join(F.broadcast(rows.agg(F.max(column).alias("__last"))), F.col(column) == F.col("__last")).drop("__last")


def line_movement(prices: DataFrame) -> DataFrame:
    """How far prices of an outcome (outcome_id, captured_at, odds) moved between captures; no row's worth with one capture."""
    moved = prices.groupBy("outcome_id").agg(F.count(F.lit(1)).alias("n"), F.min("odds").alias("lo"), F.max("odds").alias("hi")).where("n > 1").select(((F.col("hi") - F.col("lo")) / F.col("lo") * 100).alias("move"))
    captures = prices.agg(F.count_distinct("captured_at").alias("captures"))
    found = moved.agg(F.count(F.lit(1)).alias("outcomes"), (F.avg((F.col("move") < 0.01).cast("double")) * 100).alias("unmoved_pct"), F.count(F.when(F.col("move") > 10, 1)).alias("volatile"))
    middle = medians(moved, [], "move").agg(F.max("median").alias("median_pct"))
    return captures.crossJoin(found).crossJoin(middle)


def first_last_price(prices: DataFrame) -> DataFrame:
    """The first and last price of each outcome."""
    return prices.groupBy("outcome_id").agg(F.min_by("odds", "captured_at").alias("first_odds"), F.max_by("odds", "captured_at").alias("last_odds"))


def offer_margins(prices: DataFrame, least: int = 30) -> DataFrame:
    """Per market: offers whose outcomes are complete (sum of 1 / odds between 1 and 2), median margin, and if any is about a player.

    Offers are told apart by capture too, so that repeated captures don't add up."""
    offers = prices.where("market is not null").groupBy("market", "offer_id", "captured_at").agg(F.count(F.lit(1)).alias("outcomes"), F.sum(1.0 / F.col("odds")).alias("total"), F.bool_or("is_player").alias("is_player")).where("outcomes >= 2 and total > 1 and total < 2")
    counted = offers.groupBy("market").agg(F.count(F.lit(1)).alias("n_offers"), F.bool_or("is_player").alias("is_player")).where(F.col("n_offers") >= least)
    return counted.join(medians(offers, ["market"], "total"), "market").select("market", "n_offers", ((F.col("median") - 1) * 100).alias("margin_pct"), "is_player")


def combination_cost(packs: DataFrame, prices: DataFrame) -> DataFrame:
    """Per pack (pack_id, captured_at, legs as comma-joined ids, odds) all of whose legs have a price in its capture: product of the
    legs' odds and the pack's odds (the highest, where its rows differ) over it."""
    legs = packs.select("pack_id", "captured_at", F.col("odds").alias("pack_odds"), F.explode(F.transform(F.filter(F.split("legs", ","), lambda x: x != ""), lambda x: x.cast("bigint"))).alias("outcome_id"))
    priced = legs.join(prices.groupBy("captured_at", "outcome_id").agg(F.max("odds").alias("leg_odds")), ["captured_at", "outcome_id"], "left")
    whole = priced.groupBy("pack_id", "captured_at").agg(F.max("pack_odds").alias("pack_odds"), F.count(F.lit(1)).alias("n_legs"), F.count("leg_odds").alias("n_priced"), F.product("leg_odds").alias("product"))
    return whole.where("n_legs = n_priced").select("pack_id", "captured_at", "n_legs", "pack_odds", "product", (F.col("pack_odds") / F.col("product")).alias("ratio"))


def combination_summary(costs: DataFrame) -> DataFrame:
    """Ratios over all packs and by number of legs (n_legs is null in the row over all)."""
    middle = medians(costs.unionByName(costs.withColumn("n_legs", F.lit(None).cast(costs.schema["n_legs"].dataType))), ["n_legs"], "ratio").select(F.col("n_legs").alias("__n"), F.col("median").alias("median_ratio"))
    rows = costs.rollup("n_legs").agg(F.count(F.lit(1)).alias("n"), F.avg("ratio").alias("mean_ratio"), (F.avg((F.col("ratio") < 0.99).cast("double")) * 100).alias("below_pct"), (F.avg((F.col("ratio") > 1.01).cast("double")) * 100).alias("above_pct"))
    return rows.join(middle, F.col("n_legs").eqNullSafe(F.col("__n")), "left").select("n_legs", "n", "median_ratio", "mean_ratio", "below_pct", "above_pct")


def extreme_ratios(costs: DataFrame, n: int = 5) -> DataFrame:
    """The packs with the n smallest and the n largest ratios (side `low` or `high`); of equal ones those with the smallest pack_id.

    Ratios are compared to nine digits, so that the order in which legs were multiplied doesn't matter."""
    ratio = F.round("ratio", 9)
    low = costs.orderBy(ratio, "pack_id").limit(n).withColumn("side", F.lit("low"))
    high = costs.orderBy(ratio.desc(), "pack_id").limit(n).withColumn("side", F.lit("high"))
    return low.unionByName(high)


def capture_summary(prices: DataFrame) -> DataFrame:
    """Distinct things in a capture and its range of odds."""
    return prices.agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("outcome_id").alias("outcomes"), F.count_distinct("market").alias("markets"), F.count_distinct("captured_at").alias("captures"), F.min("odds").alias("least_odds"), F.max("odds").alias("most_odds"))


def top_markets(prices: DataFrame, n: int = 12) -> DataFrame:
    return prices.groupBy("market").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "market").limit(n)
