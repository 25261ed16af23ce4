"""Votes as keyed state: scores and counts that change only by what comes in.

Each micro-batch of the stream is one DataFrame job over what came in and what was kept of the batches
before: the last vote of each user on each object with its place in the order, and deletions.

* Both are dealt by object and a salt of the user and sorted once; the last vote of each user, the
  object's deletion and the vote that was known before follow from that order. The salt splits an object that
  everyone votes on.
* What is kept goes to a table of the batch's number in the checkpoint folder, and the objects whose score or
  voters differ, as (old, new), to the batch's folder of the log. A batch that runs again writes both anew.

Late votes lose against later ones that are known already, a vote that comes twice changes
nothing, a vote of 0 takes back but stays known, and a row without a user deletes the object: votes up to
its place in the order no longer count, whenever they come.

What follows from the changes needs no look at the other objects: the counts of useful assertions
move only where a score crosses 0, so they are sums over the change log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshwright.sources import store

SALTS = 16


def tallied(votes: DataFrame, kept: DataFrame | None, keys: list[str], order: list[str], salts: int = SALTS) -> DataFrame:
    """The last vote of each user on each object (`keys`) after a batch of votes (keys, user_id, vote, order columns), given those kept before.

    `was` is the vote that counted before, `vote` the one that counts now, 0 where there is none, and `stays` is false
    for votes that a deletion took. A row without a user_id deletes its object, in every salt.
    """
    one = F.array(F.pmod(F.xxhash64("user_id"), F.lit(salts)).cast("int"))
    salt = F.explode(F.when(F.col("user_id").isNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(one)).alias("salt")
    columns = [*keys, "salt", "user_id", "vote", *order]
    rows = votes.select(*keys, salt, "user_id", F.col("vote").cast("int").alias("vote"), *order).select(*columns, F.lit(None).cast("int").alias("was"))
    if kept is not None:
        rows = rows.unionByName(kept.where("stays").select(*columns, F.col("vote").alias("was")))
    group = [*keys, "salt"]
    last = F.max_by(F.struct("vote", *order), F.struct(*order, F.col("was").isNotNull(), "vote"))
    # dealt before it is grouped, so that it is sorted once
    each = rows.repartition(*group).groupBy(*group, "user_id").agg(last.alias("last"), F.coalesce(F.max("was"), F.lit(0)).alias("was"))
    at, deletion = F.struct(*[F.col("last")[c] for c in order]), F.col("user_id").isNull()
    each = each.withColumn("gone", F.max(F.when(deletion, at)).over(Window.partitionBy(*group)))
    stays = deletion | F.col("gone").isNull() | (at > F.col("gone"))
    vote = F.when(stays & ~deletion, F.col("last.vote")).otherwise(0)
    return each.select(*group, "user_id", vote.alias("vote"), *[F.col("last")[c].alias(c) for c in order], "was", stays.alias("stays"))


def changed(tally: DataFrame, keys: list[str]) -> DataFrame:
    """The objects that a batch changed: old and new score and number of voters."""
    count = lambda c: F.sum((F.col(c) != 0).cast("long"))
    total = tally.groupBy(*keys).agg(F.sum("was").alias("old_score"), F.sum("vote").alias("new_score"), count("was").alias("old_voters"), count("vote").alias("new_voters"))
    return total.where("old_score <> new_score or old_voters <> new_voters")


def follow(votes: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, salts: int = SALTS) -> StreamingQuery:
    """Writes the changes of everything that has come in to the log at `path`, each once; goes on at `checkpoint`."""

    def folder(batch: int) -> str:
        return f"{checkpoint}/kept/{batch}"

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        kept = spark.read.parquet(folder(batch - 1)) if batch else None
        tallied(rows, kept, keys, order, salts).write.mode("overwrite").parquet(folder(batch))
        changed(spark.read.parquet(folder(batch)), keys).write.mode("overwrite").parquet(f"{path}/batch={batch}")
        if batch > 1:  # the one before is needed if this batch runs again
            store.delete(spark, folder(batch - 2))

    return votes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scores(log: DataFrame, keys: list[str]) -> DataFrame:
    """Score and voters of the objects that have voters, from the change log."""
    total = log.groupBy(*keys).agg(F.sum(F.col("new_score") - F.col("old_score")).alias("score"), F.sum(F.col("new_voters") - F.col("old_voters")).alias("n_votes"))
    return total.where("n_votes > 0")


def crossings(log: DataFrame, ends: list[str]) -> DataFrame:
    """concept and +1 or -1 where an object's score rose above 0 or fell back; an object with itself at both ends counts once."""
    useful = lambda c: (F.col(c) > 0).cast("long")
    step: Column = useful("new_score") - useful("old_score")
    return log.select(F.explode(F.array_distinct(F.array(*ends))).alias("concept"), step.alias("step")).where("step <> 0")


def counts(log: DataFrame, ends: list[str]) -> DataFrame:
    """concept and num_assertions, of concepts that have any."""
    return crossings(log, ends).groupBy("concept").agg(F.sum("step").alias("num_assertions")).where("num_assertions > 0")
