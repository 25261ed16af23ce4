"""Repairs over whole tables: merges, moves, checks and back-fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions import scalars as fn
from meshwright.operators import voting
from meshwright.sources.graph import Graph


def frame_merges(frames: DataFrame) -> DataFrame:
    """frame_id and keep: frames of one relation, text and frequency go to the best, then first, of them."""
    best = Window.partitionBy("relation", "text", "freq").orderBy(F.desc("goodness"), "frame_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return frames.select("frame_id", F.first("frame_id").over(best).alias("keep"))


def repoint_raws(g: Graph) -> DataFrame:
    """Raw assertions per surviving frame once duplicates are merged."""
    merged = g.raws.join(F.broadcast(frame_merges(g.frames)), "frame_id")
    return merged.select(F.col("keep").alias("frame_id"), "relation", "c1", "c2", "freq").distinct().groupBy("frame_id").agg(F.count("*").alias("n"))


def dangling(rows: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """Rows whose reference isn't known."""
    return rows.join(known.select(*keys).distinct(), keys, "left_anti")


def unique_links(g: Graph) -> DataFrame:
    """(c1, c2) pairs by how many assertions a row that names only them could link to."""
    n = g.assertions.groupBy("c1", "c2").agg(F.count("*").alias("n"))
    status = F.when(F.col("n") == 1, "linked").otherwise("ambiguous")
    return n.groupBy(status.alias("status")).agg(F.count("*").alias("pairs"))


def move_concept(g: Graph, old: str, new: str) -> DataFrame:
    """Assertions with `old` replaced by `new`; rows that then share the five keys are one.

    Where they are voted on, the votes move: a user who has voted on both keeps the vote on what was there,
    and the score is the sum of the votes that are left. Without votes the score of what was there stays.
    """
    votes = g.votes.select("user_id", "c1", "c2", "vote")
    for column in ("c1", "c2"):
        votes = voting.moved_votes(votes, column, old, new, ["c1", "c2"])
    total = voting.scores(votes, ["c1", "c2"]).select("c1", "c2", F.col("score").alias("voted"))
    to = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
    own = ((F.col("c1") != old) & (F.col("c2") != old)).alias("own")
    five = ["relation", "c1", "c2", "freq", "value"]
    meets = F.coalesce(F.col("c1").isin(old, new), F.lit(False)) | F.coalesce(F.col("c2").isin(old, new), F.lit(False))  # the rest stays as it is
    rows = g.assertions.where(meets).select("relation", to("c1"), to("c2"), "freq", "value", "score", own)
    merged = rows.groupBy(*five).agg(F.max_by("score", F.struct("own", "score")).alias("score"))
    merged = g.assertions.where(~meets).select(*five, "score").unionByName(merged)
    score = F.when(F.col("relation") == "CapableOf", F.coalesce("voted", F.lit(0))).otherwise(F.col("score"))
    return merged.join(total, ["c1", "c2"], "left").select("relation", "c1", "c2", "freq", "value", score.alias("score"))


def implicit_votes(g: Graph) -> DataFrame:
    """Voters per object with the implied vote of its first voter added where they haven't voted the object up."""
    first = g.votes.groupBy("c1", "c2").agg(F.min("user_id").alias("user_id")).withColumn("vote", F.lit(1))
    added = first.join(g.votes.where("vote = 1").select("c1", "c2", "user_id"), ["c1", "c2", "user_id"], "left_anti")
    both = g.votes.select("c1", "c2", "user_id", "vote").unionByName(added.select("c1", "c2", "user_id", "vote"))
    return both.groupBy("c1", "c2").agg(F.count_distinct("user_id").alias("voters"), F.sum("vote").alias("score"))


def placeholder_users(g: Graph) -> DataFrame:
    """Everyone who orders or acts, once, with a placeholder name."""
    ids = g.table("orders").select(F.col("o_custkey").alias("user_id")).union(g.table("events").select("user_id")).distinct()
    return ids.select("user_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"))


def linked_uniquely(rows: DataFrame, objects: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`rows` with the one object of equal keys in `name` and a status: linked, none or ambiguous (and then no link)."""
    found = objects.groupBy(*keys).agg(F.count("*").alias("__n"), F.min(name).alias("__one"))
    n = F.coalesce("__n", F.lit(0))
    status = F.when(n == 1, "linked").when(n == 0, "none").otherwise("ambiguous")
    return rows.join(found, keys, "left").select(*rows.columns, F.when(n == 1, F.col("__one")).alias(name), status.alias("status"))


def with_creators(rows: DataFrame, votes: DataFrame, ghost: str = "_ghost", silent: str = "verbosity") -> tuple[DataFrame, DataFrame]:
    """Sentences (id, creator) with a creator each, and votes (id, user, vote) with the creators' own.

    A missing creator becomes `ghost`; a creator who hasn't voted votes 1, but for `silent`.
    """
    named = rows.withColumn("creator", F.coalesce("creator", F.lit(ghost)))
    own = named.where(F.col("creator") != silent).select("id", F.col("creator").alias("user"), F.lit(1).alias("vote"))
    return named, votes.select("id", "user", "vote").unionByName(own.join(votes.select("id", "user"), ["id", "user"], "left_anti"))
