"""Cutting lineage and connected components, for operators that iterate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.sources.store import folder, released, written

__all__ = ["components", "cut", "written"]


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the session's checkpoint folder and read from there."""
    folder(df.sparkSession)
    with released(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned in here


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's least node) for every node of `edges` (u, v).

    Alternating large and small stars: every round hangs nodes on lesser ones, and a
    round that changes nothing ends the loop. A node's neighbours are never gathered
    in one row; least neighbours are pre-aggregated and joined back.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else both.where("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        hung = near.where("v > u") if large else near
        out = hung.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            out = out.unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen.n, seen.h) == state or seen.n == 0:
            break
        state = (seen.n, seen.h)
        now = cut(star(star(now, True), False))
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
