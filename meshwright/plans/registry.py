"""Registered queries over the driver tables and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import scalars as fn
from meshwright.operators import exports, lookups, maintenance, matrix, traversal, voting
from meshwright.plans.base import ORACLES, QUERIES, query  # noqa: F401

KEY = ["c1", "c2"]


# Look-ups

_TOP = "SELECT relation, c1, c2, freq, score, {more} FROM {table} WHERE {where} ORDER BY score DESC, relation, c1, c2, freq LIMIT {limit}"


@query("api_concept_assertions", "SELECT relation, c1, c2, freq, score, CASE WHEN value >= 0 THEN 1 ELSE -1 END AS polarity FROM useful WHERE c1 = 'EUROPE' OR c2 = 'EUROPE' ORDER BY score DESC, relation, c1, c2, freq LIMIT 20")
def _(g):
    return lookups.concept_assertions(g, "EUROPE")


@query("api_forward_after_limit", "SELECT * FROM (SELECT relation, c1, c2, freq, score, CASE WHEN value >= 0 THEN 1 ELSE -1 END AS polarity FROM useful WHERE c1 = 'NATION_3' OR c2 = 'NATION_3' ORDER BY score DESC, relation, c1, c2, freq LIMIT 100) WHERE c1 = 'NATION_3'")
def _(g):
    return lookups.concept_assertions(g, "NATION_3", limit=150, direction="forward")


@query("api_feature_query", "SELECT relation, c1, c2, freq, score FROM assertions WHERE score > 0 AND relation = 'PartOf' AND c2 = 'ASIA' ORDER BY score DESC, relation, c1, c2, freq LIMIT 20")
def _(g):
    return lookups.matching_assertions(g, "right", "PartOf", "ASIA", 150)


@query("api_assertion_find", "SELECT DISTINCT relation, c1, c2, score, freq, value FROM assertions WHERE relation = 'PartOf' AND c1 = 'NATION_3' AND c2 = 'EUROPE'")
def _(g):
    return lookups.find_assertion(g, "PartOf", "NATION_3", "EUROPE")


@query("api_concept_features", "SELECT DISTINCT 'left' AS direction, relation FROM assertions WHERE c1 = 'NATION_3' UNION ALL SELECT DISTINCT 'right', relation FROM assertions WHERE c2 = 'NATION_3'")
def _(g):
    return lookups.concept_features(g, "NATION_3")


@query("api_surface_forms", "SELECT * FROM surfaces WHERE concept = 'NATION_3' ORDER BY use_count DESC, surface LIMIT 20")
def _(g):
    return lookups.surface_forms(g, "NATION_3")


_NAMES = "VALUES ('NATION_3'), ('the NATION_3'), ('a EUROPE'), ('nowhere')"


@query("flt_resolve_concept", f""", s AS (SELECT surface, concept FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY use_count DESC, concept) AS rn FROM surfaces) WHERE rn = 1)
SELECT t.text AS text, coalesce(s.concept, c.text) AS concept FROM ({_NAMES}) AS t(text) LEFT JOIN s ON s.surface = t.text LEFT JOIN concepts c ON c.text = t.text""")
def _(g):
    return lookups.resolve(g, g.spark.createDataFrame([("NATION_3",), ("the NATION_3",), ("a EUROPE",), ("nowhere",)], "text string"))


@query("src_useful_assertions", "SELECT relation, c1, c2, score, freq, value FROM useful")
def _(g):
    return g.useful


@query("agg_feature_scores", """, f AS (SELECT c1 AS concept, 'right' AS direction, relation, c2 AS other, score FROM assertions UNION ALL SELECT c2, 'left', relation, c1, score FROM assertions)
SELECT concept, direction, relation, other, max(score) AS best, max(score) > 0 AS holds FROM f GROUP BY ALL""")
def _(g):
    return lookups.feature_scores(g)


@query("agg_top_by_feature", """, h AS (SELECT *, CASE WHEN c1 = 'NATION_3' THEN 'forward' ELSE 'reverse' END AS direction FROM assertions WHERE score > 0 AND (c1 = 'NATION_3' OR c2 = 'NATION_3')),
r AS (SELECT *, row_number() OVER (PARTITION BY direction, relation ORDER BY score DESC, c1, c2, freq) AS rank, count(*) OVER (PARTITION BY direction, relation) AS size FROM h)
SELECT direction, relation, CAST(rank AS INTEGER) AS rank, c1, c2, freq, value > 0 AS positive, size FROM r WHERE rank <= 50""")
def _(g):
    return lookups.top_by_feature(g, "NATION_3")


@query("win_best_surface", "SELECT concept, arg_max(surface, (use_count, surface)) AS canonical_name FROM surfaces GROUP BY concept")
def _(g):
    return lookups.best_surface(g)


_BEST_RAW = ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation, c1, c2, freq ORDER BY score DESC, frame_id) AS rn FROM raws) WHERE rn = 1)"


@query("win_best_raw", _BEST_RAW + " SELECT * EXCLUDE (rn) FROM best")
def _(g):
    return lookups.best_raw(g)


@query("nl_assertions", _BEST_RAW + " SELECT relation, c1, c2, freq, frame_id, replace(replace(replace(frame, '{%}', ''), '{1}', trim(c1)), '{2}', trim(c2)) AS sentence FROM best")
def _(g):
    return lookups.render(g)


@query("nl_questions", _BEST_RAW + " SELECT best.relation, c1, c2, best.freq, replace(replace(replace(coalesce(question_yn, frame || '?'), '{%}', ''), '{1}', '[[' || c1 || ']]'), '{2}', '[[' || c2 || ']]') AS question FROM best JOIN frames USING (frame_id) WHERE assertion_score > 0")
def _(g):
    return lookups.questions(g)


@query("nl_feature_frames", """, f AS (SELECT *, CASE WHEN freq NOT IN ('not', 'rarely') AND goodness >= 3 THEN 0 WHEN freq NOT IN ('not', 'rarely') AND goodness >= 2 THEN 1 ELSE 2 END AS tier FROM frames)
SELECT relation, frame_id, tier, replace(replace(replace(text, '{%}', ''), '{1}', '...'), '{2}', '...') AS display FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY tier, goodness DESC, frame_id) AS rn FROM f) WHERE rn = 1""")
def _(g):
    return lookups.feature_frames(g)


# Votes and counts


@query("agg_vote_scores", "SELECT c1, c2, CAST(sum(vote) AS BIGINT) AS score, count(vote) AS n_votes FROM votes GROUP BY c1, c2")
def _(g):
    return voting.scores(g.votes, KEY)


_SCORED = ", s AS (SELECT c1, c2, CAST(sum(vote) AS BIGINT) AS score, count(vote) AS n_votes FROM votes GROUP BY c1, c2)"


@query("agg_top_objects", _SCORED + ", t AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, c1, c2 LIMIT 10) SELECT * FROM t WHERE (c1, c2) IN (SELECT c1, c2 FROM useful)")
def _(g):
    return voting.top_objects(g.votes, g.useful, KEY)


@query("agg_bottom_objects", _SCORED + ", t AS (SELECT * FROM s WHERE score < 0 ORDER BY score, c1, c2 LIMIT 10) SELECT * FROM t WHERE (c1, c2) IN (SELECT c1, c2 FROM assertions)")
def _(g):
    return voting.top_objects(g.votes, g.assertions, KEY, best=False)


@query("win_last_vote", "SELECT user_id, c1, c2, vote FROM votes")
def _(g):
    return g.votes


@query("wrt_rescore", _SCORED + " SELECT relation, a.c1, a.c2, freq, value, coalesce(s.score, 0) AS score, coalesce(n_votes, 0) AS n_votes FROM assertions a LEFT JOIN s ON a.c1 = s.c1 AND a.c2 = s.c2")
def _(g):
    return voting.rescored(g.assertions, g.votes, KEY)


@query("wrt_moderation", """ SELECT c1, c2, CAST(sum(vote) AS BIGINT) AS score, count(vote) AS n_votes FROM votes
WHERE user_id NOT IN (SELECT user_id FROM votes GROUP BY user_id HAVING sum(vote) < 0) GROUP BY c1, c2""")
def _(g):
    suspects = g.votes.groupBy("user_id").agg(F.sum("vote").alias("s")).where("s < 0")
    return voting.scores(voting.without_users(g.votes, suspects), KEY)


@query("agg_concept_counts", "SELECT text, words, visible, num_assertions FROM concepts")
def _(g):
    return g.concepts


@query("agg_recount_report", "SELECT count(*) AS concepts, count(*) FILTER (WHERE num_assertions > 2) AS significant, count(*) FILTER (WHERE NOT visible) AS hidden, CAST(sum(words) AS BIGINT) AS words FROM concepts")
def _(g):
    return g.concepts.agg(F.count("*").alias("concepts"), F.count_if(F.col("num_assertions") > 2).alias("significant"), F.count_if(~F.col("visible")).alias("hidden"), F.sum("words").alias("words"))


@query("agg_relation_distribution", "SELECT name, count(relation) AS n FROM relations LEFT JOIN assertions ON relation = name GROUP BY name")
def _(g):
    return voting.relation_distribution(g)


# Matrix

_QUADS = ", k AS (SELECT text FROM concepts WHERE num_assertions >= 5), q AS (SELECT c1, relation, c2, value / 10.0 * log2(greatest(score + 1, 1)) AS value FROM useful WHERE c1 IN (SELECT text FROM k) AND c2 IN (SELECT text FROM k))"
_CELLS = _QUADS + """, f AS (SELECT c1 AS concept, 'right' AS direction, relation, c2 AS other, value FROM q UNION ALL SELECT c2, 'left', relation, c1, value FROM q)"""
_SQUISHED = _CELLS + """, c AS (SELECT concept, direction, relation, other, sum(value) AS value FROM f GROUP BY ALL),
m AS (SELECT * FROM c WHERE concept IN (SELECT concept FROM c GROUP BY concept HAVING count(*) >= 5) AND (direction, relation, other) IN (SELECT direction, relation, other FROM c GROUP BY ALL HAVING count(*) >= 5))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 5))


@query("mat_quads", _QUADS + " SELECT c1, relation, c2, round(value, 5) AS value FROM q")
def _(g):
    return _rounded(matrix.quads(g))


@query("mat_features", _CELLS + " SELECT concept, direction, relation, other, round(value, 5) AS value FROM f")
def _(g):
    return _rounded(matrix.to_features(matrix.quads(g)))


@query("mat_concepts", _QUADS + " SELECT c1 AS row, c2 AS col, round(value, 5) AS value FROM q UNION ALL SELECT c2, c1, round(value, 5) FROM q")
def _(g):
    return _rounded(matrix.to_concepts(matrix.quads(g)))


@query("mat_pairs", _QUADS + " SELECT c1, c2, relation, round(value, 5) AS value FROM q")
def _(g):
    return _rounded(matrix.to_pairs(matrix.quads(g))).select("pair.c1", "pair.c2", "relation", "value")


@query("mat_identities", _QUADS + " SELECT DISTINCT c1, 'InheritsFrom' AS relation, c1 AS c2, 1.0::DOUBLE AS value FROM q UNION ALL SELECT c1, 'InheritsFrom', c1, round(value, 5) FROM q WHERE relation = 'IsA'")
def _(g):
    return _rounded(matrix.identities(matrix.quads(g)))


@query("mat_build", _SQUISHED + " SELECT concept, direction, relation, other, round(value, 5) AS value FROM m")
def _(g):
    return _rounded(matrix.build_matrix(matrix.quads(g))).select("concept", "direction", "relation", "other", "value")


@query("mat_normalised", _SQUISHED + """, r AS (SELECT concept, sqrt(sum(value * value)) AS r FROM m GROUP BY concept), k2 AS (SELECT direction, relation, other, sqrt(sum(value * value)) AS k FROM m GROUP BY ALL)
SELECT m.concept, m.direction, m.relation, m.other, round(value / sqrt(r * k), 5) AS value FROM m JOIN r USING (concept) JOIN k2 USING (direction, relation, other)""")
def _(g):
    return _rounded(matrix.normalised(matrix.build_matrix(matrix.quads(g))))


@query("mat_rating_quads", " SELECT user_id, v.c1, relation, v.c2, round(vote * value / 10.0, 5) AS value FROM votes v JOIN assertions a ON a.relation = 'CapableOf' AND a.c1 = v.c1 AND a.c2 = v.c2")
def _(g):
    return _rounded(matrix.rating_quads(g))


@query("mat_raw_quads", """, r AS (SELECT *, value / 10.0 * log2(greatest(score + 1, 1)) AS v FROM raws WHERE score > 0), x AS (
  SELECT 'the ' || c1 AS c1, CAST(frame_id AS VARCHAR) AS relation, 'the ' || c2 AS c2, v AS value FROM r UNION ALL SELECT c1, relation, c2, v FROM r
  UNION ALL SELECT c1, 'NormalizesTo', 'the ' || c1, 1 FROM r UNION ALL SELECT c2, 'NormalizesTo', 'the ' || c2, 1 FROM r
  UNION ALL SELECT c1, 'NormalizesTo', c1, 1 FROM r UNION ALL SELECT c2, 'NormalizesTo', c2, 1 FROM r)
SELECT c1, relation, c2, round(value, 5) AS value FROM x""")
def _(g):
    return _rounded(matrix.raw_quads(g))


@query("mat_similarity", """WITH q AS (SELECT 0 AS z, list(x ORDER BY i) AS q FROM (SELECT i, sum(embedding[i]::DOUBLE * w) AS x FROM embeddings, (VALUES (1, 1.0), (2, 0.5)) AS t(id, w), range(1, 65) AS r(i) WHERE vec_id = id GROUP BY i))
SELECT * FROM (SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q), 5) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 20) WHERE score > 0""", graph=False)
def _(g):
    return matrix.similar(g.table("embeddings"), {1: 1.0, 2: 0.5})


# Traversal


@query("gra_network", "SELECT c1, c2, relation AS rel, score, freq FROM useful WHERE c1 <> c2 AND c1 <> '' AND c2 <> ''")
def _(g):
    return traversal.network(g)


@query("gra_analogy", """, m AS (SELECT relation, c2, score AS s1, value AS v1 FROM useful WHERE c1 = 'Supplier#000000001'),
x AS (SELECT u.c1, log2(greatest(value + v1 + (score + s1) * 0.5 + 2, 1)) / 2 * CASE u.relation WHEN 'HasProperty' THEN 3 WHEN 'UsedFor' THEN 2 WHEN 'CapableOf' THEN 2 WHEN 'ReceivesAction' THEN 1.5 ELSE 1 END AS s, u.relation || '/' || u.c2 AS t
  FROM useful u JOIN m ON u.relation = m.relation AND u.c2 = m.c2 WHERE u.c1 <> 'Supplier#000000001')
SELECT c1 AS candidate, round(sum(s), 5) AS score, string_agg(DISTINCT t, ',' ORDER BY t) AS structures FROM x GROUP BY c1 ORDER BY score DESC, candidate LIMIT 50""")
def _(g):
    return traversal.analogous(g, "Supplier#000000001")


# Scalar functions


@query("fn_edge_values", "SELECT relation, c1, c2, freq, round(value / 10.0 * log2(greatest(score + 1, 1)), 5) + 0.0 AS weight, CASE WHEN value >= 0 THEN 1 ELSE -1 END AS polarity FROM assertions")
def _(g):
    return g.assertions.select("relation", "c1", "c2", "freq", F.round(fn.edge_value(F.col("score"), F.col("value")), 5).alias("weight"), fn.polarity(F.col("value")).alias("polarity"))


@query("fn_branching_discount", ", d AS (SELECT c1, count(*) AS d FROM useful GROUP BY c1) SELECT c1, round(exp(-power(ln(d + 5) / ln(5) - 2.5, 2) / 2) / sqrt(2 * pi()), 6) AS discount FROM d")
def _(g):
    d = g.useful.groupBy("c1").agg(F.count("*").alias("d"))
    return d.select("c1", F.round(fn.branching_discount(F.col("d").cast("double")), 6).alias("discount"))


# Maintenance

_MERGED = ", k AS (SELECT frame_id, first_value(frame_id) OVER (PARTITION BY relation, text, freq ORDER BY goodness DESC, frame_id) AS keep FROM frames)"


@query("wrt_frame_merges", _MERGED + " SELECT frame_id, keep FROM k")
def _(g):
    return maintenance.frame_merges(g.frames)


@query("wrt_repoint_raws", _MERGED + " SELECT keep AS frame_id, count(DISTINCT (relation, c1, c2, freq)) AS n FROM raws JOIN k USING (frame_id) GROUP BY keep")
def _(g):
    return maintenance.repoint_raws(g)


@query("jn_dangling", "SELECT relation, u.c1, c2, freq FROM useful u LEFT JOIN (SELECT DISTINCT c1 FROM useful) v ON v.c1 = u.c2 WHERE v.c1 IS NULL")
def _(g):
    return maintenance.dangling(g.useful.select("relation", "c1", "c2", "freq"), ["c2"], g.useful.select(F.col("c1").alias("c2"))).select("relation", "c1", "c2", "freq")


@query("wrt_unique_links", "SELECT CASE WHEN n = 1 THEN 'linked' ELSE 'ambiguous' END AS status, count(*) AS pairs FROM (SELECT c1, c2, count(*) AS n FROM assertions GROUP BY c1, c2) GROUP BY status")
def _(g):
    return maintenance.unique_links(g)


@query(
    "wrt_move_concept",
    """, t AS (SELECT 'Supplier#000000001' AS old, 'Supplier#000000002' AS new),
v AS (SELECT user_id, CASE WHEN c1 = old THEN new ELSE c1 END AS c1, c2, vote, c1 <> old AS there FROM votes, t),
w AS (SELECT c1, c2, vote FROM (SELECT *, row_number() OVER (PARTITION BY user_id, c1, c2 ORDER BY there DESC) AS rn FROM v) WHERE rn = 1),
s AS (SELECT c1, c2, CAST(sum(vote) AS BIGINT) AS total FROM w GROUP BY c1, c2),
a AS (SELECT relation, CASE WHEN c1 = old THEN new ELSE c1 END AS c1, CASE WHEN c2 = old THEN new ELSE c2 END AS c2, freq, value, score, c1 <> old AND c2 <> old AS there FROM assertions, t),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation, c1, c2, freq ORDER BY there DESC, score DESC) AS rn FROM a) WHERE rn = 1)
SELECT relation, b.c1, b.c2, freq, value, CASE WHEN relation = 'CapableOf' THEN coalesce(total, 0) ELSE score END AS score FROM b LEFT JOIN s ON s.c1 = b.c1 AND s.c2 = b.c2""",
)
def _(g):
    return maintenance.move_concept(g, "Supplier#000000001", "Supplier#000000002")


@query("wrt_implicit_votes", """, f AS (SELECT c1, c2, min(user_id) AS user_id FROM votes GROUP BY c1, c2), a AS (SELECT c1, c2, user_id, 1 AS vote FROM f WHERE (c1, c2, user_id) NOT IN (SELECT c1, c2, user_id FROM votes WHERE vote = 1)),
b AS (SELECT c1, c2, user_id, vote FROM votes UNION ALL SELECT * FROM a) SELECT c1, c2, count(DISTINCT user_id) AS voters, CAST(sum(vote) AS BIGINT) AS score FROM b GROUP BY c1, c2""")
def _(g):
    return maintenance.implicit_votes(g)


@query("wrt_placeholder_users", "SELECT user_id, 'user_' || user_id AS username FROM (SELECT o_custkey AS user_id FROM orders UNION SELECT user_id FROM events)", graph=False)
def _(g):
    return maintenance.placeholder_users(g)


# Exports


@query("snk_denormalised", _BEST_RAW + """, n AS (SELECT concept, arg_max(surface, (use_count, surface)) AS name FROM surfaces GROUP BY concept)
SELECT relation, c1, c2, freq, x.name AS name1, y.name AS name2, replace(replace(replace(frame, '{%}', ''), '{1}', trim(c1)), '{2}', trim(c2)) AS sentence FROM best JOIN n x ON x.concept = c1 JOIN n y ON y.concept = c2""")
def _(g):
    return exports.denormalised(g)


@query("snk_n3", """ SELECT '<#' || url_encode(c1) || '> <' || relation || '> <#' || url_encode(c2) || '> . # "' || replace(freq, '"', '_') || '" ' || score AS line FROM useful
UNION ALL SELECT '<#' || url_encode(text) || '> <name> "' || replace(text, '"', '_') || '" .' FROM (SELECT c1 AS text FROM useful UNION SELECT c2 FROM useful)""")
def _(g):
    return exports.n3(g)


@query("snk_triples", """, s AS (SELECT relation || '|' || c1 || '|' || c2 || '|' || freq AS subject, * FROM useful)
SELECT subject, 'type' AS predicate, 'Statement' AS object FROM s UNION ALL SELECT subject, 'subject', c1 FROM s UNION ALL SELECT subject, 'predicate', relation FROM s UNION ALL SELECT subject, 'object', c2 FROM s
UNION ALL SELECT subject, 'score', CAST(score AS VARCHAR) FROM s UNION ALL SELECT subject, 'frequency', freq FROM s UNION ALL SELECT subject, 'value', CAST(value AS VARCHAR) FROM s""")
def _(g):
    return exports.triples(g)


@query("snk_edge_list", """ SELECT c1, c2, '{"rel":"' || relation || '","score":' || score || ',"freq":"' || freq || '"}' AS data FROM useful WHERE c1 <> c2""")
def _(g):
    return exports.edge_list(g)


@query("prj_urls", " SELECT text, '/en/concept/' || replace(url_encode(text), '%20', '+') || '/' AS url FROM concepts")
def _(g):
    return exports.urls(g)


# the other query modules register themselves
from meshwright.plans import derived_queries, file_queries, graph_queries, job_queries, point_queries, stream_queries, write_queries  # noqa: E402, F401
