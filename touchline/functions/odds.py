"""Odds, probability and line expressions, all built-in functions of Spark.  Nulls give nulls unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Home field in rating points, rating step, first rating.
ELO_HOME, ELO_STEP, ELO_START = 60.0, 20.0, 1500.0
#: Days after which a match counts half.
HALF_LIFE = 365.0


def number(c: Column) -> Column:
    """Text or number as double; null where it isn't one, and for NaN."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def whole(c: Column) -> Column:
    """Text or number as int, cut toward zero."""
    return number(c).try_cast("int")


def decimal_odds(c: Column) -> Column:
    """Decimal odds over 0."""
    value = number(c)
    return F.when(value > 0, value)


def milli_odds(c: Column) -> Column:
    """Thousandths as decimal odds; null unless over 1."""
    value = number(c) / 1000.0
    return F.when(value > 1, value)


def milli_line(c: Column) -> Column:
    return number(c) / 1000.0


def overround(*odds: Column) -> Column:
    """Sum of 1 / odds over the odds above 1; null with fewer than two."""
    usable = [F.when(o > 1, 1.0 / o) for o in odds]
    total = sum((F.coalesce(u, F.lit(0.0)) for u in usable[1:]), F.coalesce(usable[0], F.lit(0.0)))
    count = sum((u.isNotNull().cast("int") for u in usable[1:]), usable[0].isNotNull().cast("int"))
    return F.when(count >= 2, total)


def implied(odds: Column, total: Column) -> Column:
    """Probability with the margin taken out in proportion."""
    return F.when(odds > 1, 1.0 / odds / total)


def points(scored: Column, conceded: Column) -> Column:
    return F.when(scored > conceded, 3).when(scored == conceded, 1).when(scored < conceded, 0)


def result_letter(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(home < away, "A").when(home == away, "D")


def elo_expectation(home: Column, away: Column) -> Column:
    """Expected score of the home side, a draw counting half."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -(home + ELO_HOME - away) / 400.0))


def time_weight(days: Column, half_life: float = HALF_LIFE) -> Column:
    return F.pow(F.lit(0.5), days / half_life)


def poisson(k: Column, mean: Column) -> Column:
    """P(k) of a Poisson variable by a running product, which holds for any k."""
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    product = F.aggregate(steps, F.exp(-mean), lambda p, i: p * mean / i)
    return F.when(k == 0, F.exp(-mean)).when(k > 0, product)


def tau(h: Column, a: Column, lam: Column, mu: Column, rho: Column) -> Column:
    """The correction of the four low scores."""
    return (
        F.when((h == 0) & (a == 0), 1 - lam * mu * rho)
        .when((h == 0) & (a == 1), 1 + lam * rho)
        .when((h == 1) & (a == 0), 1 + mu * rho)
        .when((h == 1) & (a == 1), 1 - rho)
        .otherwise(1.0)
    )


def halves(line: Column) -> Column:
    """The lines that a bet is split into: two for a quarter line, else one."""
    quarter = F.abs(F.pmod(F.abs(line * 4), F.lit(2.0)) - 1) < 1e-9
    return F.when(quarter, F.array(line - 0.25, line + 0.25)).when(line.isNotNull(), F.array(line))


def effective(win: Column, lose: Column) -> Column:
    """Probability to compare with decimal odds: returned stakes count neither way."""
    return F.when(win + lose > 0, win / (win + lose)).otherwise(0.0)


def expected_value(win: Column, lose: Column, odds: Column) -> Column:
    """Per unit staked."""
    return win * (odds - 1) - lose


def clipped(*p: Column, least: float = 1e-9) -> list[Column]:
    """Probabilities at least that large, adding up to 1."""
    kept = [F.greatest(F.least(x, F.lit(1.0)), F.lit(least)) for x in p]
    total = sum(kept[1:], kept[0])
    return [x / total for x in kept]
