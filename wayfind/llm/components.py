"""Connected components of any graph by alternating large-star and small-star steps, each a minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60) -> DataFrame:
    """v and root, the least vertex of its component, for every vertex that isn't a root itself. edges: u, v of any one comparable type, both ways or one, loops ignored."""

    def oriented(df: DataFrame) -> DataFrame:
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    def large(e: DataFrame, i: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        # written, so that both sides of the join are plain shuffles and the edges of a hub can be split
        least = scratch.keep(least, f"{name}-least{i}", files=1 + before[0] // 250_000)
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        tied = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return tied.unionByName(least.select("u", F.col("m").alias("v")))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = scratch.keep(oriented(edges).distinct(), f"{name}-0")
    before = state(now)
    for i in range(1, rounds):
        if not before[0]:
            break
        # no step adds edges: files for a quarter of a million each
        new = scratch.keep(small(oriented(large(now, i)).distinct()).distinct(), f"{name}-{i}", files=1 + before[0] // 250_000)
        scratch.drop(f"{name}-{i - 1}", f"{name}-least{i}")
        now, after = new, state(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components aren't found after {rounds} rounds")
    return now.select(F.col("u").alias("v"), F.col("v").alias("root"))
