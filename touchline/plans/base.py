"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.plans.fixtures import Tables, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function of Tables under its name, and the SQL that gives the same rows."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if oracle:
            ORACLES[f.__name__] = duck(oracle)
        return f

    return register


def nearest(value: Column, digits: int) -> Column:
    """round() of a double, without its decimals where the value is no large one and not by a tie; there both give the double next to the same decimal."""
    scaled = value * float(10**digits)
    plain = (F.abs(scaled) < 1e9) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-5)
    return F.when(plain, F.floor(scaled + 0.5) / float(10**digits)).otherwise(F.round(value, digits))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    doubles = {c for c, kind in df.dtypes if kind == "double"}
    return df.withColumns({n: (nearest(F.col(n), digits) if n in doubles else F.round(n, digits)) + F.lit(0.0) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})
