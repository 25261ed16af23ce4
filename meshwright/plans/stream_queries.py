"""Queries whose rows come through a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.plans.base import query
from meshwright.sources import store
from meshwright.sources.graph import ORDER
from meshwright.streaming import ledger
from meshwright.streaming import votes as stream


def followed(votes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The change log of all votes of a stream."""
    spark = votes.sparkSession
    path = store.fresh(spark, "changes")
    ledger.follow(votes, keys, order, path, store.fresh(spark, "state")).awaitTermination()
    return spark.read.parquet(path)


#: Files of a ship year, so that no task writes a whole one.
FILES = 16


def sliced(g, log: DataFrame) -> DataFrame:
    """The vote log as a stream of ship years, three at a time, in no special order."""
    path = store.fresh(g.spark, "log")
    year = F.coalesce(F.year("l_shipdate"), F.lit(0)).alias("slice")
    part = F.pmod(F.xxhash64("l_orderkey", "c1"), F.lit(FILES)).alias("part")
    log.select("*", year, part).repartition("slice", "part").drop("part").write.partitionBy("slice").parquet(path)
    kept = g.spark.read.parquet(path)
    return g.spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", 3 * FILES).parquet(path).drop("slice")


_EVENTS = """WITH e AS (SELECT user_id, event_id % 97 AS object_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS vote, ts, event_id FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, object_id ORDER BY ts DESC, event_id DESC) AS rn FROM e) WHERE rn = 1 AND vote <> 0)
SELECT object_id, CAST(sum(vote) AS BIGINT) AS score, count(*) AS n_votes FROM l GROUP BY object_id"""


@query("str_event_votes", _EVENTS, graph=False)
def _(g):
    # a pattern, as a stream takes a folder or a pattern, and the table may be one file
    events = g.spark.readStream.schema(g.table("events").schema).parquet(f"{g.sf_dir}/event[s].parquet")
    return ledger.scores(followed(stream.event_votes(events), ["object_id"], ["ts", "event_id"]), ["object_id"])


_ENDS = "SELECT concept, count(*) AS num_assertions FROM (SELECT c1 AS concept FROM s UNION ALL SELECT c2 FROM s WHERE c1 <> c2) GROUP BY concept"


@query("wrt_incremental_counts", f", s AS (SELECT c1, c2 FROM votes GROUP BY c1, c2 HAVING sum(vote) > 0) {_ENDS}")
def _(g):
    return ledger.counts(followed(sliced(g, g.vote_log), ["c1", "c2"], ORDER), ["c1", "c2"])


#: Objects of these suppliers are deleted when 1995 begins; later votes count again.
_GONE, _WHEN = "right(c1, 1) = '7'", "1995-01-01 00:00:00"


@query(
    "wrt_deleted_counts",
    f""", l AS (SELECT * FROM vote_log WHERE NOT ({_GONE} AND l_shipdate <= TIMESTAMP '{_WHEN}')),
w AS (SELECT c1, c2, vote FROM (SELECT *, row_number() OVER (PARTITION BY user_id, c1, c2 ORDER BY {", ".join(c + " DESC" for c in ORDER)}) AS rn FROM l) WHERE rn = 1),
s AS (SELECT c1, c2 FROM w GROUP BY c1, c2 HAVING sum(vote) > 0) {_ENDS}""",
)
def _(g):
    gone = g.vote_log.where(_GONE).select("c1", "c2").distinct()
    fields = {f.name: f.dataType for f in g.vote_log.schema}
    largest = {c: F.lit(2**31 - 1).cast(fields[c]) if c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice") else F.lit("~") for c in ORDER if c != "l_shipdate"}
    deletion = gone.withColumns({"user_id": F.lit(None).cast(fields["user_id"]), "vote": F.lit(0), "freq": F.lit(""), "l_shipdate": F.lit(_WHEN).cast(fields["l_shipdate"]), **largest})
    return ledger.counts(followed(sliced(g, g.vote_log.unionByName(deletion)), ["c1", "c2"], ORDER), ["c1", "c2"])
