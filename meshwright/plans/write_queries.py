"""Queries of writes: bulk statements, votes, merges and repairs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from meshwright.functions import scalars as fn
from meshwright.operators import extraction, maintenance, traversal, voting, writes
from meshwright.plans.base import query


def voted_statements(g):
    """Each vote on a CapableOf object as a statement of one frame."""
    return g.votes.select(
        "user_id", F.lit("CapableOf").alias("relation"), F.lit("").alias("freq"), F.lit("{1} can make {2}").alias("frame"),
        F.concat(F.lit("the "), "c1").alias("text1"), F.col("c2").alias("text2"), "vote", F.lit(1).cast("long").alias("at"),
    )


@query("wrt_statements", " SELECT 'CapableOf' AS relation, 'the ' || c1 AS best_surface1, c2 AS best_surface2, CAST(sum(vote) AS BIGINT) AS score FROM votes GROUP BY c1, c2")
def _(g):
    base = writes.state(writes.empty(g.spark), voted_statements(g))
    return writes.assertions(base).select("relation", "best_surface1", "best_surface2", "score")


@query("wrt_statement_concepts", """, s AS (SELECT c1, c2, sum(vote) AS score FROM votes GROUP BY c1, c2), p AS (SELECT DISTINCT c2 FROM votes)
SELECT p.c2 AS concept, count(s.c2) AS num_assertions FROM p LEFT JOIN s ON s.c2 = p.c2 AND score > 0 GROUP BY p.c2""")
def _(g):
    base = writes.state(writes.empty(g.spark), voted_statements(g))
    named = base.surfaces.where("surface not like 'the %'").select("surface", "concept")
    return writes.concepts(base).join(named, "concept").select(F.col("surface").alias("concept"), "num_assertions")


@query("wrt_statement_surfaces", " SELECT surface, count(*) AS use_count FROM (SELECT DISTINCT 'the ' || c1 AS surface, c2 FROM votes UNION ALL SELECT DISTINCT c2, c1 FROM votes) GROUP BY surface")
def _(g):
    base = writes.state(writes.empty(g.spark), voted_statements(g))
    return writes.surface_counts(base).select("surface", "use_count")


@query("wrt_statement_events", " SELECT user_id, count(*) * 3 AS n FROM votes GROUP BY user_id")
def _(g):
    base = writes.state(writes.empty(g.spark), voted_statements(g))
    return base.events.groupBy("user_id").agg(F.count("*").alias("n"))


_E = "WITH e AS (SELECT user_id, event_id % 97 AS object_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS vote, event_id AS t FROM events)"


def event_votes(g):
    vote = F.when(F.col("event_type").isin("purchase", "click"), 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return g.table("events").select(F.lit("raw").alias("kind"), (F.col("event_id") % 97).cast("string").alias("object"), "user_id", vote.alias("vote"), F.col("event_id").alias("at"))


@query("wrt_vote_upserts", _E + ", l AS (SELECT object_id, user_id, arg_max(vote, t) AS vote FROM e GROUP BY object_id, user_id) SELECT CAST(object_id AS VARCHAR) AS object, CAST(sum(vote) AS BIGINT) AS score, count(*) AS n_votes FROM l WHERE vote <> 0 GROUP BY object_id", graph=False)
def _(g):
    return writes.scores(writes.vote(writes.empty(g.spark), event_votes(g)), "raw")


@query("wrt_vote_log", _E + " SELECT user_id, count(*) AS n FROM e GROUP BY user_id", graph=False)
def _(g):
    return writes.vote(writes.empty(g.spark), event_votes(g)).events.groupBy("user_id").agg(F.count("*").alias("n"))


@query("wrt_ratings", _E + ", l AS (SELECT object_id, user_id, arg_max(vote, t) AS vote FROM e GROUP BY object_id, user_id) SELECT 'raw' AS kind, CAST(object_id AS VARCHAR) AS object, user_id, CAST(vote AS INTEGER) AS vote FROM l WHERE vote <> 0", graph=False)
def _(g):
    none = F.lit(None).cast("string")
    rated = event_votes(g).select(none.alias("sentence"), F.col("object").alias("raw"), none.alias("assertion"), "user_id", (F.col("vote") * 3).alias("rating"), "at")
    return writes.ratings_to_votes(rated)[0].select("kind", "object", "user_id", "vote")


@query("wrt_merge_raws", """WITH r AS (SELECT o_orderkey AS raw_id, o_custkey % 40 AS s, o_orderkey % 30 AS p, o_orderkey % 5 AS creator, o_custkey AS user_id, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END AS vote FROM orders),
k AS (SELECT *, first_value(raw_id) OVER (PARTITION BY s, p ORDER BY CASE WHEN creator = 0 THEN 1 ELSE 0 END, raw_id) AS keep FROM r),
v AS (SELECT keep, user_id, vote, row_number() OVER (PARTITION BY keep, user_id ORDER BY raw_id = keep DESC, raw_id) AS rn FROM k)
SELECT keep AS raw_id, user_id, CAST(vote AS INTEGER) AS vote FROM v WHERE rn = 1""", graph=False)
def _(g):
    o = g.table("orders").select(F.col("o_orderkey").alias("raw_id"), (F.col("o_custkey") % 40).alias("s"), (F.col("o_orderkey") % 30).alias("p"), (F.col("o_orderkey") % 5).alias("creator"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", -1).otherwise(1).alias("vote"))
    return writes.merge_duplicate_raws(o.select("raw_id", "s", "p", "creator"), o.select("raw_id", "user_id", "vote"), ["s", "p"], 0)[1]


@query("win_consecutive_duplicates", "SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders QUALIFY before IS NOT NULL", graph=False)
def _(g):
    return writes.consecutive_duplicates(g.table("orders").select("o_orderkey", "o_custkey"), ["o_custkey"], "o_orderkey")


@query("wrt_initial_votes", " SELECT relation || c1 || c2 || freq || frame_id AS raw_id, creator AS user_id, 1 AS vote FROM raws WHERE c1 <> 'HOUSEHOLD' AND c2 <> 'HOUSEHOLD' AND c1 <> 'EUROPE' AND c2 <> 'EUROPE'")
def _(g):
    rows = g.raws.select(F.concat("relation", "c1", "c2", "freq", F.col("frame_id").cast("string")).alias("raw_id"), "creator", "c1", "c2")
    return writes.initial_votes(rows, g.spark.createDataFrame([("HOUSEHOLD",), ("EUROPE",)], "concept string"))


@query("wrt_without_user_on", " SELECT c1, c2, CAST(sum(vote) AS BIGINT) AS score FROM votes WHERE user_id <> 7 GROUP BY c1, c2")
def _(g):
    name = F.concat_ws("|", F.lit("CapableOf"), "c1", "c2")
    cast = g.votes.select(F.lit("assertion").alias("kind"), name.alias("object"), "user_id", "vote", F.lit(1).cast("long").alias("at"))
    base = writes.without_user_on(replace(writes.empty(g.spark), votes=cast), 7, "CapableOf")
    part = F.split("object", r"\|")
    return writes.scores(base, "assertion").select(part[1].alias("c1"), part[2].alias("c2"), "score")


@query("wrt_unswitch", " SELECT * FROM (VALUES (1, 'a dog', 'the barking', false), (2, 'dogs', 'bark', true), (3, 'x', 'x', false)) AS t(id, text1, text2, swapped)", graph=False)
def _(g):
    df = g.spark.createDataFrame([(1, "a dog", "the barking", "a dog", "the barking"), (2, "bark", "dogs", "a dog", "barks"), (3, "x", "x", "x", "x")], "id int, text1 string, text2 string, parsed1 string, parsed2 string")
    return writes.unswitched(df).select("id", "text1", "text2", "swapped")


@query("wrt_templated", " SELECT * FROM (VALUES ('dog', 'bark', 'not', -1), ('cat', 'purr', '', 1)) AS t(text1, text2, freq, vote)", graph=False)
def _(g):
    df = g.spark.createDataFrame([(1, "CapableOf", -1, "{1} can {2}", "dog", "bark", -4, 1), (2, "CapableOf", 1, "{1} can {2}", "cat", "purr", 5, 1)], "user_id long, relation string, polarity int, frame string, text1 string, text2 string, rating int, at long")
    return writes.templated(df).select("text1", "text2", "freq", "vote")


@query("jn_polymorphic_votes", """ SELECT 'assertion' AS kind, c1 || '|' || c2 AS object, CAST(sum(vote) AS BIGINT) AS score FROM votes GROUP BY c1, c2
UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), CAST(sum(vote) AS BIGINT) FROM votes GROUP BY user_id""")
def _(g):
    each = F.array(F.struct(F.lit("assertion").alias("kind"), F.concat_ws("|", "c1", "c2").alias("object")), F.struct(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("object")))
    return g.votes.select(F.explode(each).alias("o"), "vote").groupBy("o.kind", "o.object").agg(F.sum("vote").alias("score"))


@query("wrt_unique_link_rows", """, n AS (SELECT c1, c2, count(*) AS n, min(relation) AS relation FROM assertions GROUP BY c1, c2), r AS (SELECT DISTINCT c1, c2 FROM votes UNION SELECT 'nowhere', 'EUROPE')
SELECT r.c1, r.c2, CASE WHEN n = 1 THEN relation END AS relation, CASE WHEN n = 1 THEN 'linked' WHEN n IS NULL THEN 'none' ELSE 'ambiguous' END AS status FROM r LEFT JOIN n ON r.c1 = n.c1 AND r.c2 = n.c2""")
def _(g):
    rows = g.votes.select("c1", "c2").unionByName(g.spark.createDataFrame([("nowhere", "EUROPE")], "c1 string, c2 string")).distinct()
    return maintenance.linked_uniquely(rows, g.assertions.select("c1", "c2", "relation"), ["c1", "c2"], "relation")


@query("wrt_creator_votes", """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 10 = 0 THEN '_ghost' WHEN o_custkey % 10 = 1 THEN 'verbosity' ELSE 'u' || o_custkey END AS creator FROM orders),
v AS (SELECT o_orderkey AS id, 'u' || o_custkey AS "user", -1 AS vote FROM orders WHERE o_orderkey % 3 = 0)
SELECT * FROM v UNION ALL SELECT id, creator, 1 FROM o WHERE creator <> 'verbosity' AND (id, creator) NOT IN (SELECT id, "user" FROM v)""", graph=False)
def _(g):
    key = F.col("o_custkey")
    name = F.concat(F.lit("u"), key.cast("string"))
    rows = g.table("orders").select(F.col("o_orderkey").alias("id"), F.when(key % 10 == 0, None).when(key % 10 == 1, "verbosity").otherwise(name).alias("creator"))
    votes = g.table("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), name.alias("user"), F.lit(-1).alias("vote"))
    return maintenance.with_creators(rows, votes)[1]


@query("txt_loaded_assertions")
def _(g):
    sentences = g.raws.where("relation in ('PartOf', 'IsA') and goodness >= 4").select(F.concat("surface1", F.when(F.col("relation") == "IsA", F.lit(" is a kind of ")).otherwise(F.lit(" is part of ")), "surface2").alias("sentence"))
    return writes.assertions(writes.state(writes.empty(g.spark), extraction.loaded(sentences)))


@query("wrt_move_votes", """, m AS (SELECT user_id, CASE WHEN c1 = 'Supplier#000000001' THEN 'Supplier#000000002' ELSE c1 END AS c1, c2, vote, c1 <> 'Supplier#000000001' AS own FROM votes),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, c1, c2 ORDER BY own DESC) AS rn FROM m) SELECT c1, c2, CAST(sum(vote) AS BIGINT) AS score, count(*) AS n_votes FROM k WHERE rn = 1 GROUP BY c1, c2""")
def _(g):
    return voting.scores(voting.moved_votes(g.votes, "c1", "Supplier#000000001", "Supplier#000000002", ["c1", "c2"]), ["c1", "c2"])


@query("wrt_without_upvoters", " SELECT c1, c2, CAST(sum(vote) AS BIGINT) AS score, count(vote) AS n_votes FROM votes WHERE user_id NOT IN (SELECT user_id FROM votes WHERE c1 = 'Supplier#000000001' AND vote = 1) GROUP BY c1, c2")
def _(g):
    gone = voting.upvoters(g.votes, F.col("c1") == "Supplier#000000001")
    return voting.scores(voting.without_users(g.votes, gone), ["c1", "c2"])


@query("srt_latest_events", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20", graph=False)
def _(g):
    return g.table("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id", "event_type")


@query("agg_score_merge", ", s AS (SELECT c2, least(greatest(score, 0), 9) / 10.0 AS p FROM useful) SELECT c2, round(1 - exp(sum(ln(1 - p))), 6) AS merged FROM s GROUP BY c2")
def _(g):
    p = F.least(F.greatest(F.col("score"), F.lit(0)), F.lit(9)) / 10
    return g.useful.select("c2", p.alias("p")).groupBy("c2").agg(F.round(traversal.probabilistic_or(F.col("p")), 6).alias("merged"))


@query("fn_stray_spaces", " SELECT ' ' || surface AS surface, trim(' ' || surface) AS clean FROM surfaces")
def _(g):
    spaced = F.concat(F.lit(" "), "surface")
    return g.surfaces.select(spaced.alias("surface"), fn.stripped(spaced).alias("clean"))


@query("flt_visibility", " SELECT text, text NOT IN ('HOUSEHOLD', 'ECONOMY') AS visible FROM concepts")
def _(g):
    blocked = g.spark.createDataFrame([("HOUSEHOLD",), ("ECONOMY",)], "text string").withColumn("blocked", F.lit(True))
    return g.concepts.select("text").join(F.broadcast(blocked), "text", "left").select("text", F.col("blocked").isNull().alias("visible"))


@query("agg_users_of_both", " SELECT user_id, bool_or(v) AS votes, bool_or(NOT v) AS acts FROM (SELECT DISTINCT user_id, true AS v FROM votes UNION ALL SELECT DISTINCT user_id, false FROM events) GROUP BY user_id")
def _(g):
    both = g.votes.select("user_id").distinct().withColumn("v", F.lit(True)).unionByName(g.table("events").select("user_id").distinct().withColumn("v", F.lit(False)))
    return both.groupBy("user_id").agg(F.bool_or("v").alias("votes"), F.bool_or(~F.col("v")).alias("acts"))
