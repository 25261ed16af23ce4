"""Votes, scores and the denormalised counts that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.sources.graph import Graph


def last_votes(log: DataFrame, user: str, keys: list[str], order: list[str]) -> DataFrame:
    """The last vote of each user on each object; a last vote of 0 takes it back."""
    last = Window.partitionBy(user, *keys).orderBy(*(F.desc(c) for c in order))
    return log.withColumn("rn", F.row_number().over(last)).where("rn = 1 and vote <> 0").drop("rn")


def scores(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Sum and count of votes; objects without votes are absent."""
    return votes.groupBy(*keys).agg(F.sum("vote").alias("score"), F.count("vote").alias("n_votes"))


def top_objects(votes: DataFrame, objects: DataFrame, keys: list[str], limit: int = 10, best: bool = True) -> DataFrame:
    """The best objects of positive score, or the worst of negative; missing objects go after the limit."""
    found = scores(votes, keys)
    found = found.where("score > 0").orderBy(F.desc("score"), *keys) if best else found.where("score < 0").orderBy("score", *keys)
    return found.limit(limit).join(objects.select(*keys).distinct(), keys, "left_semi")


def rescored(objects: DataFrame, votes: DataFrame, keys: list[str]) -> DataFrame:
    """Objects with `score` recomputed, 0 without votes."""
    return objects.drop("score").join(scores(votes, keys), keys, "left").withColumns({"score": F.coalesce("score", F.lit(0)), "n_votes": F.coalesce("n_votes", F.lit(0))})


def relation_distribution(g: Graph) -> DataFrame:
    """Assertions per described relation, those with none included."""
    n = g.assertions.groupBy(F.col("relation").alias("name")).agg(F.count("*").alias("n"))
    return g.relations.join(n, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n"))


def without_users(votes: DataFrame, suspects: DataFrame) -> DataFrame:
    """Votes without those of the listed users."""
    return votes.join(suspects, "user_id", "left_anti")


def moved_votes(votes: DataFrame, column: str, old: str, new: str, keys: list[str]) -> DataFrame:
    """Votes with `old` renamed to `new` in a key; of a user's votes that then meet, the one that was there stays."""
    meets = F.coalesce(F.col(column).isin(old, new), F.lit(False))
    moved = votes.where(meets).withColumns({"own": F.col(column) != old, column: F.lit(new)})
    moved = moved.groupBy("user_id", *keys).agg(F.max_by("vote", "own").alias("vote"))
    return votes.where(~meets).select("user_id", *keys, "vote").unionByName(moved)


def upvoters(votes: DataFrame, where) -> DataFrame:
    """Users with a vote of 1 on an object that the condition names."""
    return votes.where(where).where("vote = 1").select("user_id").distinct()
