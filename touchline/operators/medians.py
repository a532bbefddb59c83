"""Exact medians by counting: no task holds a group's values, however many there are.

Values are first summed up by group and value.  The range that holds the wanted rank is then cut into BUCKETS, rows are counted by bucket, and the
bucket in which the rank lies becomes the next range, until it has LAST different values at most, which are counted through one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import kept

BUCKETS, LAST = 4096, 2048


def medians(rows: DataFrame, keys: list[str], value: str, buckets: int = BUCKETS, last: int = LAST) -> DataFrame:
    """keys and median of the values that aren't null or NaN, the mean of the middle two where their number is even; groups without values have no row.

    Null keys are groups too."""
    names = [f"__k{i}" for i in range(len(keys))] or ["__k0"]
    key = [F.struct(F.col(k)).alias(n) for n, k in zip(names, keys, strict=False)] or [F.lit(0).alias("__k0")]  # a struct of null is equal to another one
    values = rows.select(*key, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    base = kept(values.groupBy(*names, "v").agg(F.count(F.lit(1)).alias("w")))
    whole = base.groupBy(*names).agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("different"))
    ranks = F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))).alias("rank")
    wanted = kept(whole.select(*names, "lo", "hi", "different", F.lit(0).cast("long").alias("below"), ranks).distinct())
    by = [*names, "rank"]
    while not wanted.where(F.col("different") > last).isEmpty():
        near = wanted.where(F.col("different") > last)
        inside = base.join(near, names).where("v between lo and hi")
        bucket = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * buckets), F.lit(buckets - 1)).alias("bucket")
        counts = inside.select(*by, "below", "v", "w", bucket).groupBy(*by, "below", "bucket").agg(F.sum("w").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("different"))
        upto = F.sum("w").over(Window.partitionBy(*by).orderBy("bucket"))
        holds = counts.withColumn("upto", F.col("below") + upto).where("rank < upto and rank >= upto - w")
        found = holds.select(*names, "lo", "hi", "different", (F.col("upto") - F.col("w")).alias("below"), "rank")
        wanted = kept(wanted.where(F.col("different") <= last).unionByName(found))
    inside = base.join(wanted, names).where("v between lo and hi")
    upto = F.col("below") + F.sum("w").over(Window.partitionBy(*by).orderBy("v"))
    middle = inside.withColumn("upto", upto).where("rank < upto and rank >= upto - w")
    # an odd number of values has one middle rank, an even one two
    found = middle.groupBy(*names).agg((F.min("v") / 2 + F.max("v") / 2).alias("median"))
    return found.select(*(F.col(f"{n}.{k}").alias(k) for n, k in zip(names, keys, strict=False)), "median")
