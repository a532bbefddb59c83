"""Connected components of links, in DataFrame functions, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import on_hot_keys, staged


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n")).select("u", F.least("u", "m").alias("m"), "__n")
    return on_hot_keys(both, least, "u", 2 * total).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n"))
    moved = on_hot_keys(down, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v: longs) to node and root, the smallest node of its component; roots themselves are left out.

    Every round is written to the shared folder.  Self-links, nulls and repeated links are harmless.
    """
    edges = staged(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    state, total = None, edges.count()
    for _ in range(most_rounds if total else 0):
        edges = staged(_small_star(_large_star(edges, total), total))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
        total = now[0]
    else:
        if total:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
