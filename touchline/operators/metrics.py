"""Scores of probabilistic forecasts.  Rows have p1, px, p2 and the outcome y as 0, 1 or 2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.odds import clipped

P = ("p1", "px", "p2")


def normalised(rows: DataFrame, least: float = 1e-9) -> DataFrame:
    return rows.withColumns(dict(zip(P, clipped(*map(F.col, P), least=least), strict=True)))


def brier() -> Column:
    """Squared error summed over the classes, averaged over rows."""
    return F.avg(sum((F.pow(F.col(p) - (F.col("y") == k).cast("double"), 2) for k, p in enumerate(P)), F.lit(0.0)))


def picked() -> Column:
    """The probability given to what happened."""
    return F.when(F.col("y") == 0, F.col("p1")).when(F.col("y") == 1, F.col("px")).when(F.col("y") == 2, F.col("p2"))


def log_loss() -> Column:
    return -F.avg(F.ln(F.greatest(F.least(picked(), F.lit(1.0)), F.lit(1e-15))))


def choice() -> Column:
    """The likeliest class, the lowest of equal ones."""
    p1, px, p2 = map(F.col, P)
    return F.when((p1 >= px) & (p1 >= p2), 0).when(px >= p2, 1).otherwise(2)


def accuracy() -> Column:
    return F.avg((choice() == F.col("y")).cast("double"))


def by_class(rows: DataFrame, *keep: str) -> DataFrame:
    """A row per class: its probability p and whether it happened."""
    long = F.explode(F.array(*(F.struct(F.lit(k).alias("class"), F.col(p).alias("p"), (F.col("y") == k).cast("double").alias("hit")) for k, p in enumerate(P)))).alias("c")
    return rows.select(*keep, long).select(*keep, "c.*")


def calibration_left(rows: DataFrame, bins: int = 10, least: int = 30) -> DataFrame:
    """Bins [a, b), the last one closed, by class: rows, mean probability and frequency."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return by_class(rows).withColumn("bin", at).groupBy("class", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("hit").alias("frequency")).where(F.col("n") >= least)


def calibration_right(rows: DataFrame, p: str, hit: str, bins: int = 10, least: int = 30) -> DataFrame:
    """Bins (a, b], for 0 < p < 1, by comparison with the edges themselves."""
    at = sum(((F.col(p) > F.lit(i) / F.lit(float(bins))).cast("int") for i in range(1, bins)), F.lit(0))
    kept = rows.where((F.col(p) > 0) & (F.col(p) < 1)).withColumn("bin", at)
    return kept.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(hit).alias("frequency")).where(F.col("n") >= least).withColumn("gap", F.col("frequency") - F.col("mean_p"))


def calibration_error(rows: DataFrame, *keys: str, bins: int = 10) -> DataFrame:
    """Expected calibration error: weighted gaps of the left-closed bins, averaged over the classes."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    binned = by_class(rows, *keys).withColumn("bin", at).groupBy(*keys, "class", "bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("hit") - F.avg("p")).alias("gap"))
    return binned.groupBy(*keys).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def evaluate(rows: DataFrame, *keys: str) -> DataFrame:
    """All scores, by keys (a model, a league); probabilities are clipped and renormalised first."""
    rows = normalised(rows)
    scores = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), brier().alias("brier_sum"), (brier() / 3).alias("brier_class"), log_loss().alias("log_loss"), accuracy().alias("accuracy"))
    errors = calibration_error(rows, *keys)
    return scores.join(errors, list(keys)) if keys else scores.crossJoin(errors)


def compare(scores: DataFrame, reference: str, key: str = "model") -> DataFrame:
    """Each model's Brier score against the reference's."""
    base = scores.where(F.col(key) == reference).select(F.col("brier_class").alias("__base")).limit(1)
    return scores.crossJoin(F.broadcast(base)).withColumns({"delta": F.col("brier_class") - F.col("__base"), "better": F.col("brier_class") < F.col("__base")}).drop("__base")


def likelihood_weights(rows: DataFrame, key: str = "model") -> DataFrame:
    """Weights of models: softmax of minus the log loss."""
    losses = rows.groupBy(key).agg(log_loss().alias("loss"))
    everyone = Window.partitionBy()
    raw = losses.withColumn("__e", F.exp(F.min("loss").over(everyone) - F.col("loss")))
    return raw.withColumn("weight", F.col("__e") / F.sum("__e").over(everyone)).drop("__e")


def elo_signal(rows: DataFrame) -> DataFrame:
    """How an expectation (p) of the home score (y_score) does against the base rate; both over all rows, from one pass of moments."""
    moments = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col("p") - F.col("y_score"), 2)).alias("brier"), F.var_pop("y_score").alias("base_brier"))
    return moments.withColumn("gain_pct", (1 - F.col("brier") / F.col("base_brier")) * 100).withColumn("leak", F.col("brier") < 0.12)


def mean_deviation(rows: DataFrame, other: tuple[str, str, str]) -> DataFrame:
    """Mean absolute difference to other probabilities over rows and classes."""
    return rows.agg((F.avg(sum((F.abs(F.col(p) - F.col(q)) for p, q in zip(P, other, strict=True)), F.lit(0.0))) / 3).alias("deviation"))
