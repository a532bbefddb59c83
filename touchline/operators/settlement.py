"""Settlement of legs and tickets.

A leg (market, selection, line, period, side, odds) settles on a score (home_goals, away_goals, home_goals_ht,
away_goals_ht) to the shares won and returned; both are null where the market, the period's score or the side isn't
known.  Corner markets stay open: goals don't settle them.  Second halves are full time minus half time.  The line of a
handicap is in the perspective of the backed team.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.odds import halves
from touchline.functions.text import market_normal


def _pair(won: Column, returned: Column | None = None) -> Column:
    returned = F.lit(0.0) if returned is None else returned
    return F.struct(won.cast("double").alias("won"), returned.cast("double").alias("returned"))


def _split(line: Column, margin) -> Column:
    """Mean over the parts of a line: margin(part) is over 0 for a win, 0 for a return."""
    parts = halves(line)
    mean = lambda f: F.aggregate(F.transform(parts, lambda x: F.when(f(margin(x)), 1.0).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x) / F.size(parts)
    return _pair(mean(lambda m: m > 0), mean(lambda m: m == 0))


#: What read_legs() makes of a leg's text: how it settles, its selection, period and side as numbers, and an exact score as text.
TERMS = "__terms"
_KINDS = ("result", "double", "no_draw", "both", "exact", "team_total", "total", "three_way", "handicap")
_PERIODS, _SIDES = ("completo", "primera", "segunda"), ("local", "visitante")


def read_legs(legs: DataFrame) -> DataFrame:
    """Legs with a column TERMS, all that settling needs of their text.  It may be added to the few texts that many legs are made of."""
    market, sel = market_normal(F.col("market")), market_normal(F.col("selection"))
    rows = legs.select("*", F.explode(F.array(F.struct(market.alias("market"), sel.alias("sel")))).alias("__t"))
    market, sel = F.col("__t.market"), F.col("__t.sel")
    side, number = F.col("side"), lambda x: F.lit(_KINDS.index(x)).cast("tinyint")
    kind = (
        F.when(market.contains("esquina") | market.contains("corner"), None)
        .when(market.contains("resultado final") | (market == "resultado"), number("result"))
        .when(market.contains("doble oportunidad"), number("double"))
        .when(market.contains("sin empate"), number("no_draw"))
        .when(market.contains("ambos equipos"), number("both"))
        .when(market.contains("resultado correcto"), number("exact"))
        .when(market.contains("total de goles de") | (market.startswith("total") & side.isNotNull()), number("team_total"))
        .when(market.startswith("total"), number("total"))
        .when(market.contains("handicap 3-way"), number("three_way"))
        .when(market.contains("handicap"), number("handicap"))
    )
    # bits: is 1, 2 or x; has 1, 2 or x; begins with s; begins with mas
    flags = [sel == "1", sel == "2", sel == "x", sel.contains("1"), sel.contains("2"), sel.contains("x"), sel.startswith("s"), sel.startswith("mas")]
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0)).cast("smallint")
    place = lambda c, names: F.when(c == names[0], F.lit(0)).when(c == names[1], F.lit(1)).when(c == names[-1], F.lit(len(names) - 1)).cast("tinyint")
    period = place(F.coalesce(F.col("period"), F.lit("completo")), _PERIODS)
    exact = F.when(kind == number("exact"), F.replace(sel, F.lit(" "), F.lit("")))
    return rows.withColumn(TERMS, F.struct(kind.alias("kind"), bits.alias("bits"), period.alias("period"), place(side, _SIDES).alias("side"), exact.alias("exact"))).drop("__t")


def settle(term: Callable[[str], Column] = lambda c: F.col(f"{TERMS}.{c}")) -> Column:
    """struct(won, returned) of a row with a leg's terms and line and its match's columns; term gives a term by its name."""
    kind, bits, period, side = (term(c) for c in ("kind", "bits", "period", "side"))
    score = lambda s: F.when(period == 0, F.col(f"{s}_goals")).when(period == 1, F.col(f"{s}_goals_ht")).when(period == 2, F.col(f"{s}_goals") - F.col(f"{s}_goals_ht"))
    h, a = score("home"), score("away")
    d, line = h - a, F.col("line")
    has = lambda bit: bits.bitwiseAND(bit) > 0
    real = lambda x, first=0: F.when(x > 0, has(1 << first)).when(x < 0, has(2 << first)).otherwise(has(4 << first))
    over = F.when(has(128), 1).otherwise(-1)
    team = F.when(side == 0, h).when(side == 1, a)
    own = F.when(side == 0, d).when(side == 1, -d)
    number = lambda c: c.cast("double")
    rules = {
        "result": _pair(real(d)),
        "double": _pair(real(d, 3)),
        "no_draw": _pair((d != 0) & real(d), d == 0),
        "both": _pair(((h > 0) & (a > 0)) == has(64)),
        "exact": _pair(term("exact") == F.concat_ws("-", h.cast("int"), a.cast("int"))),
        "team_total": F.when(team.isNotNull() & line.isNotNull(), _split(line, lambda x: (number(team) - x) * over)),
        "total": F.when(line.isNotNull(), _split(line, lambda x: (number(h + a) - x) * over)),
        "three_way": F.when(line.isNotNull(), _pair(real(number(d) + line))),
        "handicap": F.when(line.isNotNull() & own.isNotNull(), _split(line, lambda x: number(own) + x)),
    }
    rule = F.lit(None)
    for k, name in reversed(list(enumerate(_KINDS))):
        rule = F.when(kind == k, rules[name]).otherwise(rule)
    return F.when(h.isNotNull() & a.isNotNull(), rule)


def settle_legs(legs: DataFrame, scores: DataFrame, key: str = "event_id") -> DataFrame:
    """Legs with won, returned and payout per unit; null where the match or the rule is missing.  Legs with TERMS aren't read again."""
    legs = legs if TERMS in legs.columns else read_legs(legs)
    # terms travel to the scores as columns of their own: as a struct, with its own header in each row, they take more shuffle
    terms = {c: f"__t_{c}" for c in legs.schema[TERMS].dataType.names}
    legs = legs.withColumns({to: F.col(f"{TERMS}.{c}") for c, to in terms.items()}).drop(TERMS)
    rows = legs.join(scores.select(key, "home_goals", "away_goals", "home_goals_ht", "away_goals_ht"), key, "left")
    settled = settle(lambda c: F.col(terms[c]))
    rows = rows.select("*", F.explode(F.array(settled)).alias("__s")).withColumns({"won": F.col("__s.won"), "returned": F.col("__s.returned")}).drop("__s", *terms.values())
    return rows.withColumn("payout", F.col("won") * F.col("odds") + F.col("returned"))


def settle_tickets(legs: DataFrame, scores: DataFrame, ticket: str = "ticket_id") -> DataFrame:
    """Tickets all of whose legs settle: payout (the product of the legs', in the order of their events), net return, and whether it paid."""
    # a window gets the payouts as plain rows, and a large ticket's may spill; lists would be sent by each task for the few legs that it holds of a ticket
    in_order = Window.partitionBy(ticket).orderBy("event_id", "payout")
    every = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = {"n_legs": F.count(F.lit(1)), "n_settled": F.count("payout"), "payout": F.product("payout")}
    rows = settle_legs(legs, scores).select(ticket, F.row_number().over(in_order).alias("place"), *(c.over(every).alias(n) for n, c in over.items()))
    return rows.where("place = 1 and n_legs = n_settled").select(ticket, "n_legs", "payout", (F.col("payout") - 1).alias("net"), (F.col("payout") > 1).alias("paid"))


def scores_from_results(results: DataFrame) -> DataFrame:
    """Scores of landed results (event_id, status, score.fullTime/halfTime home and away) that are finished."""
    full, half = "score.fullTime", "score.halfTime"
    return results.where((F.col("status") == "FINISHED") & F.col(f"{full}.home").isNotNull() & F.col(f"{full}.away").isNotNull()).select("event_id", F.col(f"{full}.home").alias("home_goals"), F.col(f"{full}.away").alias("away_goals"), F.col(f"{half}.home").alias("home_goals_ht"), F.col(f"{half}.away").alias("away_goals_ht"))
