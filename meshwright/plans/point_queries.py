"""Queries of point look-ups, raw assertions, features and wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwright.functions import scalars as fn
from meshwright.operators import lookups, points
from meshwright.plans.base import query

_FILL = "replace(replace(replace({0}, '{{%}}', ''), '{{1}}', {1}), '{{2}}', {2})".format
_RAW = f"relation, c1, c2, freq, frame_id, goodness, score, creator, surface1 AS text1, surface2 AS text2, {_FILL('frame', 'trim(surface1)', 'trim(surface2)')} AS sentence, assertion_score"
_BEST = ", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation, c1, c2, freq ORDER BY score DESC, frame_id) AS rn FROM raws) WHERE rn = 1)"
_NAMED = ", names AS (SELECT concept, arg_max(surface, (use_count, surface)) AS name FROM surfaces GROUP BY concept)"


@query("flt_relation", "SELECT name FROM relations WHERE name = 'IsA'")
def _(g):
    return points.lookup(g, "relation", "IsA")


@query("api_language", "SELECT id, name, sentence_count FROM languages WHERE id = 'en'")
def _(g):
    return points.lookup(g, "language", "en")


@query("api_frequency", "SELECT text, value FROM frequencies WHERE text = 'rarely'")
def _(g):
    return points.lookup(g, "frequency", "rarely")


@query("api_frame", "SELECT * FROM frames WHERE frame_id = 7")
def _(g):
    return points.lookup(g, "frame", 7)


@query("api_concept", "SELECT * FROM concepts WHERE text = 'EUROPE'")
def _(g):
    return points.lookup(g, "concept", "EUROPE")


@query("api_surface", "SELECT * FROM surfaces WHERE surface = 'the EUROPE'")
def _(g):
    return points.lookup(g, "surface", "the EUROPE")


@query("api_surface_missing", "SELECT * FROM surfaces WHERE surface = 'nowhere'")
def _(g):
    return points.lookup(g, "surface", "nowhere")


@query("api_assertion", "SELECT relation, c1, c2, score, freq, value FROM assertions WHERE relation = 'PartOf' AND c1 = 'NATION_3' AND freq = 'always'")
def _(g):
    return g.assertions.where("relation = 'PartOf' and c1 = 'NATION_3' and freq = 'always'")


@query("api_raw", "SELECT * FROM raws WHERE c1 = 'NATION_3' AND relation = 'PartOf' AND freq = 'always' AND frame_id = 10")
def _(g):
    return g.raws.where("c1 = 'NATION_3' and relation = 'PartOf' and freq = 'always' and frame_id = 10")


@query("api_assertion_raws", f"SELECT {_RAW} FROM raws WHERE relation = 'PartOf' AND c1 = 'NATION_3' AND freq = 'always'")
def _(g):
    region = g.assertions.where("relation = 'PartOf' and c1 = 'NATION_3'").select("c2").first()
    return points.assertion_raws(g, "PartOf", "NATION_3", region.c2 if region else "", "always")


@query("api_concept_raws", f"SELECT {_RAW} FROM raws WHERE (c1 = 'NATION_3' OR c2 = 'NATION_3') AND score > 0 AND assertion_score > 0")
def _(g):
    return points.concept_raws(g, "NATION_3")


@query("api_concept_raws_no_copies", _BEST + f" SELECT {_RAW} FROM best WHERE (c1 = 'NATION_3' OR c2 = 'NATION_3') AND score > 0 AND assertion_score > 0")
def _(g):
    return points.concept_raws_no_copies(g, "NATION_3")


@query("api_matching_raws_left", f"SELECT {_RAW} FROM raws WHERE relation = 'PartOf' AND surface1 IN (SELECT surface FROM surfaces WHERE concept = 'NATION_3')")
def _(g):
    return points.matching_raws(g, "left", "PartOf", "NATION_3")


@query("api_matching_raws_right", f"SELECT {_RAW} FROM raws WHERE relation = 'AtLocation' AND c2 = 'NATION_3'")
def _(g):
    return points.matching_raws(g, "right", "AtLocation", "NATION_3")


@query("api_raws_of_frame", f"SELECT {_RAW} FROM raws WHERE frame_id = 7 ORDER BY score DESC, relation, c1, c2, freq LIMIT 100")
def _(g):
    return points.raws_of_frame(g, 7, 150)


@query("api_rated_object", " SELECT relation, a.c1, a.c2, freq, score, user_id, vote, CASE vote WHEN 1 THEN 'Up' WHEN -1 THEN 'Down' END AS display FROM assertions a LEFT JOIN votes v ON a.c1 = v.c1 AND a.c2 = v.c2 WHERE a.c1 = 'Supplier#000000001'")
def _(g):
    return points.rated(g, "Supplier#000000001")


@query("wrt_votes_of_user", "SELECT c1, c2, vote, vote = 1 AS is_upvote, vote = -1 AS is_downvote FROM votes WHERE user_id = 7")
def _(g):
    return points.votes_of_user(g, 7)


@query("wrt_votes_of_nobody", "SELECT c1, c2, vote, vote = 1 AS is_upvote, vote = -1 AS is_downvote FROM votes WHERE false")
def _(g):
    return points.votes_of_user(g, None)


@query("flt_exists", "SELECT t.text AS text, EXISTS (SELECT 1 FROM concepts c WHERE c.text = t.text) OR EXISTS (SELECT 1 FROM surfaces s WHERE s.surface = t.text) AS found FROM (VALUES ('EUROPE'), ('the EUROPE'), ('nowhere')) AS t(text)")
def _(g):
    return points.exists(g, g.spark.createDataFrame([("EUROPE",), ("the EUROPE",), ("nowhere",)], "text string"))


@query("flt_normalised_get", "SELECT * FROM (VALUES ('the EUROPE', 'EUROPE'), ('those europes', 'EUROPE'), ('nowhere', NULL)) AS t(text, concept)")
def _(g):
    return points.resolve_normalised(g, g.spark.createDataFrame([("the EUROPE",), ("those europes",), ("nowhere",)], "text string"))


@query("flt_no_best_raw", _BEST + " SELECT a.relation, a.c1, a.c2, a.freq FROM assertions a LEFT JOIN (SELECT DISTINCT relation, c1, c2, freq FROM best) b ON b.relation = a.relation AND b.c1 = a.c1 AND b.c2 = a.c2 AND b.freq = a.freq WHERE b.c1 IS NULL")
def _(g):
    best = lookups.best_raw(g).select(*points.ASSERTION, "frame_id")
    return g.assertions.join(best, points.ASSERTION, "left").where(F.col("frame_id").isNull()).select(*points.ASSERTION)


@query("flt_worded_like", f"SELECT {_FILL('frame', 'trim(surface1)', 'trim(surface2)')} AS sentence, creator FROM raws WHERE lower(surface1) = lower('THE nation_3')")
def _(g):
    return points.worded_like(g, "THE nation_3")


@query("flt_count_strong", "SELECT count(*) AS n FROM assertions WHERE score >= 3")
def _(g):
    return g.assertions.where("score >= 3").agg(F.count("*").alias("n"))


@query("flt_reverse", "SELECT relation, c1, c2, freq, score FROM useful WHERE c2 = 'NATION_3'")
def _(g):
    return g._useful(g.by_c2.where("c2 = 'NATION_3'")).select("relation", "c1", "c2", "freq", "score")


@query("flt_known_vocabulary", ", w AS (SELECT text, unnest(string_split(lower(text), ' ')) AS w FROM concepts) SELECT text FROM concepts WHERE text NOT IN (SELECT text FROM w WHERE w NOT IN (SELECT lower(text) FROM concepts))")
def _(g):
    each = g.concepts.select("text", F.explode(F.split(F.lower("text"), " ")).alias("w"))
    unknown = each.join(g.concepts.select(F.lower("text").alias("w")).distinct(), "w", "left_anti").select("text").distinct()
    return g.concepts.select("text").join(unknown, "text", "left_anti")


@query("srt_page", "SELECT text FROM concepts WHERE text > 'NATION_3' ORDER BY text LIMIT 100")
def _(g):
    return points.page(g.concepts.select("text"), ["text"], ("NATION_3",))


@query("prj_admin_list", "SELECT relation, c1, c2, freq, score FROM assertions WHERE relation = 'AtLocation' ORDER BY c1, c2, freq LIMIT 100")
def _(g):
    return points.page(g.assertions.where("relation = 'AtLocation'").select("relation", "c1", "c2", "freq", "score"), ["c1", "c2", "freq"], None)


@query("srt_relation_ends", "SELECT relation, arg_min(c1, (c1, c2, freq)) AS first_c1, arg_min(c2, (c1, c2, freq)) AS first_c2, arg_max(c1, (c1, c2, freq)) AS last_c1, arg_max(c2, (c1, c2, freq)) AS last_c2 FROM assertions GROUP BY relation")
def _(g):
    return points.relation_ends(g)


@query("srt_sample", " SELECT relation, c1, c2, freq, score FROM assertions WHERE relation = 'AtLocation' AND score > 0 ORDER BY md5(relation || '|' || c1 || '|' || c2 || '|' || freq || '|1'), relation, c1, c2, freq LIMIT 10")
def _(g):
    return points.sample(g, "AtLocation", 10)


@query("prj_frame_use", "SELECT f.frame_id, goodness > 2 AS preferred, coalesce(n, 0) AS n_raws, coalesce(k, 0) AS n_creators FROM frames f LEFT JOIN (SELECT frame_id, count(*) AS n, count(DISTINCT creator) AS k FROM raws GROUP BY frame_id) r ON f.frame_id = r.frame_id")
def _(g):
    return points.raw_counts(g)


@query("prj_feature_forms", """, t AS (SELECT DISTINCT 'right' AS d, relation, c2 AS o FROM useful WHERE c1 = 'NATION_3' UNION SELECT DISTINCT 'left', relation, c1 FROM useful WHERE c2 = 'NATION_3')
SELECT CASE d WHEN 'left' THEN o || '\\' || relation ELSE relation || '/' || o END AS code, '/api/en/' || d || 'feature/' || relation || '/' || url_encode(o) || '/' AS uri,
  CASE d WHEN 'left' THEN o ELSE 'NATION_3' END AS c1, relation, CASE d WHEN 'left' THEN 'NATION_3' ELSE o END AS c2, true AS round_trip FROM t""")
def _(g):
    return points.feature_forms(g, "NATION_3")


@query("prj_features_all", """ SELECT 'right' AS direction, relation, c2 AS concept, freq, score FROM assertions WHERE c1 = 'NATION_3' UNION ALL SELECT 'left', relation, c1, freq, score FROM assertions WHERE c2 = 'NATION_3'""")
def _(g):
    return points.features_of(g, "NATION_3", useful_only=False).select("feature.direction", "feature.relation", "feature.concept", "freq", "score")


@query("prj_reprs", """ SELECT 'assertion' AS kind, relation || '(' || c1 || ', ' || c2 || ')[' || freq || ']' AS text FROM assertions WHERE c1 = 'Supplier#000000001'
UNION ALL SELECT 'raw', 'en: (''' || surface1 || ''' ' || relation || ' ''' || surface2 || ''') s=' || score FROM raws WHERE c1 = 'Supplier#000000001'""")
def _(g):
    return points.reprs(g, "Supplier#000000001")


@query("agg_grouped_features", _NAMED + """, t AS (SELECT 'right' AS direction, relation, c2 AS concept, freq, score FROM assertions WHERE c1 = 'NATION_3' UNION ALL SELECT 'left', relation, c1, freq, score FROM assertions WHERE c2 = 'NATION_3' AND c1 <> 'NATION_3')
SELECT direction, relation, t.concept, name AS surface, freq, score FROM t JOIN names ON names.concept = t.concept""")
def _(g):
    return points.grouped_features(g, "NATION_3")


@query("nl_raws", f" SELECT relation, c1, c2, freq, frame_id, {_FILL('frame', 'trim(surface1)', 'trim(surface2)')} AS sentence FROM raws")
def _(g):
    return points.worded_raws(g)


@query("nl_raws_wrapped", f" SELECT relation, c1, c2, freq, frame_id, {_FILL('frame', chr(39) + '<b>' + chr(39) + ' || trim(surface1) || ' + chr(39) + '</b>' + chr(39), chr(39) + '<b>' + chr(39) + ' || trim(surface2) || ' + chr(39) + '</b>' + chr(39))} AS sentence FROM raws")
def _(g):
    return points.worded_raws(g, lambda c: F.concat(F.lit("<b>"), c, F.lit("</b>")))


@query("nl_propositions", f""", p AS (SELECT *, row_number() OVER (PARTITION BY c1, relation, c2 ORDER BY CASE WHEN goodness >= 3 THEN 0 ELSE 1 END, score DESC, freq, frame_id) AS rn FROM raws)
SELECT c1, relation, c2, frame_id, surface1 AS text1, surface2 AS text2, {_FILL('frame', 'surface1', 'surface2')} AS statement FROM p WHERE rn = 1""")
def _(g):
    return points.proposition_parts(g)


@query("nl_feature_parts", f""", m AS (SELECT 0 AS tier, score, frame_id, frame, surface2 AS text FROM raws WHERE relation = 'AtLocation' AND c2 = 'NATION_3' AND value > 0 AND goodness >= 3 ORDER BY score DESC, frame_id, text LIMIT 1)
SELECT CAST(frame_id AS INTEGER) AS frame_id, tier, '___' AS text1, text AS text2, {_FILL('frame', chr(39) + '___' + chr(39), 'text')} AS statement FROM m""")
def _(g):
    return points.feature_parts(g, "right", "AtLocation", "NATION_3")


@query("src_adjacency", """, e AS (SELECT c1 AS node, 'fwd' AS direction, c2 AS other, relation FROM useful UNION ALL SELECT c2, 'rev', c1, relation FROM useful),
r AS (SELECT *, (row_number() OVER (PARTITION BY node, direction ORDER BY relation, other) - 1) // 1000 AS chunk FROM e)
SELECT node, direction, CAST(chunk AS INTEGER) AS chunk, count(*) AS n, min(relation || '/' || other) AS first_edge, max(relation || '/' || other) AS last_edge FROM r GROUP BY node, direction, chunk""")
def _(g):
    return points.adjacency(g).select("node", "direction", "chunk", F.size("edges").cast("long").alias("n"), F.array_min("edges").alias("first_edge"), F.array_max("edges").alias("last_edge"))


@query("src_predicates", " SELECT relation, c1, c2 FROM useful")
def _(g):
    return g.useful.select("relation", "c1", "c2")


@query("agg_surface_counts", " SELECT surface, concept, use_count FROM surfaces")
def _(g):
    return g.surfaces


@query("agg_vote_score", " SELECT coalesce(CAST(sum(vote) AS BIGINT), 0) AS score, count(vote) AS n_votes FROM votes WHERE c1 = 'nobody'")
def _(g):
    return g.votes.where("c1 = 'nobody'").agg(F.coalesce(F.sum("vote"), F.lit(0)).alias("score"), F.count("vote").alias("n_votes"))


@query("agg_recount_fixed", """, a AS (SELECT text, count(*) AS old FROM (SELECT c1 AS text FROM assertions UNION ALL SELECT c2 FROM assertions WHERE c1 <> c2) GROUP BY text)
SELECT count(*) FILTER (WHERE old <> num_assertions) AS fixed, count(*) FILTER (WHERE num_assertions > 2) AS significant, count(*) AS concepts FROM concepts JOIN a USING (text)""")
def _(g):
    old = g.assertions.select(F.explode(F.array_distinct(F.array("c1", "c2"))).alias("text")).groupBy("text").agg(F.count("*").alias("old"))
    return g.concepts.join(old, "text").agg(F.count_if(F.col("old") != F.col("num_assertions")).alias("fixed"), F.count_if(F.col("num_assertions") > 2).alias("significant"), F.count("*").alias("concepts"))


@query("agg_sentences_by_language", " SELECT 'en' AS language, count(*) AS sentence_count FROM raws")
def _(g):
    return g.raws.groupBy(F.lit("en").alias("language")).agg(F.count("*").alias("sentence_count"))


@query("agg_feature_groups", """, h AS (SELECT *, CASE WHEN c1 = 'NATION_3' THEN 'forward' ELSE 'reverse' END AS direction FROM assertions WHERE score > 0 AND (c1 = 'NATION_3' OR c2 = 'NATION_3'))
SELECT direction, relation, count(*) AS size, CAST(row_number() OVER (ORDER BY count(*) DESC, direction, relation) AS INTEGER) AS place FROM h GROUP BY direction, relation""")
def _(g):
    from pyspark.sql import Window

    groups = lookups.top_groups(g, "NATION_3")
    # a concept has a few groups: relations times two
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.desc("size"), "direction", "relation")))


@query("agg_top_surfaces", _BEST + """, h AS (SELECT a.*, CASE WHEN a.c1 = 'EUROPE' THEN 'forward' ELSE 'reverse' END AS direction, CASE WHEN a.c1 = 'EUROPE' THEN surface2 ELSE surface1 END AS surface
  FROM assertions a JOIN best b ON a.relation = b.relation AND a.c1 = b.c1 AND a.c2 = b.c2 AND a.freq = b.freq WHERE a.score > 0 AND (a.c1 = 'EUROPE' OR a.c2 = 'EUROPE')),
r AS (SELECT *, row_number() OVER (PARTITION BY direction, relation ORDER BY score DESC, c1, c2, freq) AS rank, count(*) OVER (PARTITION BY direction, relation) AS size FROM h)
SELECT direction, relation, CAST(rank AS INTEGER) AS rank, surface, freq, value > 0 AS positive, score, size FROM r WHERE rank <= 50""")
def _(g):
    return lookups.top_surfaces(g, "EUROPE")


# Scalar functions


@query("fn_adverbs", """, t AS (SELECT * FROM (VALUES ('almost never', -10), ('', 5), ('foo', 5), ('usually always', 8), ('Seldom', -2), ('hardly ever', -2), ('often', 6), ('almost', 9), ('most', 8), ('occasionally', 2), ('not all', -5)) AS t(adverb, value))
SELECT adverb, CAST(t.value AS INTEGER) AS value, text AS freq FROM t JOIN frequencies f ON f.value = t.value""")
def _(g):
    texts = ["almost never", "", "foo", "usually always", "Seldom", "hardly ever", "often", "almost", "most", "occasionally", "not all"]
    df = g.spark.createDataFrame([(t,) for t in texts], "adverb string")
    return df.withColumn("value", fn.adverb_value(F.col("adverb"))).withColumn("freq", fn.frequency_text(F.col("value")))


@query("fn_relation_renames", """ SELECT * FROM (VALUES ('FirstSubeventOf', 'HasFirstSubevent', false), ('DesirousEffectOf', 'CausesDesire', false), ('ThematicKLine', 'ConceptuallyRelatedTo', false), ('SubeventOf', 'HasSubevent', false),
('SuperThematicKLine', 'ConceptuallyRelatedTo', false), ('LastSubeventOf', 'HasLastSubevent', false), ('LocationOf', 'AtLocation', false), ('CapableOfReceivingAction', 'ReceivesAction', false), ('PrerequisiteEventOf', 'HasPrerequisite', false),
('MotivationOf', 'MotivatedByGoal', false), ('PropertyOf', 'HasProperty', false), ('EffectOf', 'Causes', false), ('DesireOf', 'Desires', false), ('IsA', 'IsA', false), ('PropertyOfInverse', 'HasProperty', true), ('IsAInverse', 'IsA', true)) AS t(old, name, reverse)""", graph=False)
def _(g):
    df = g.spark.createDataFrame([(t,) for t in [*fn.RENAMED, "IsA", "PropertyOfInverse", "IsAInverse"]], "old string")
    return df.withColumn("r", fn.renamed_relation(F.col("old"))).select("old", "r.name", "r.reverse")


@query("fn_dependencies", " SELECT * FROM (VALUES ('prep_of(runs-2, dog-1)', 'prep_of', 'runs', 2, 'dog', 1), ('prep_of(runs-2, dog-1)', 'prep', 'runs', 2, 'dog', 1), ('conj_and(a-1, b-3)', 'conj_and', 'a', 1, 'b', 3), ('conj_and(a-1, b-3)', 'conj', 'a', 1, 'b', 3), ('nsubj(x-1, y-2)', 'nsubj', 'x', 1, 'y', 2), ('bad', NULL, NULL, NULL, NULL, NULL)) AS t(text, linktype, word1, index1, word2, index2)", graph=False)
def _(g):
    df = g.spark.createDataFrame([("prep_of(runs-2, dog-1)",), ("conj_and(a-1, b-3)",), ("nsubj(x-1, y-2)",), ("bad",)], "text string")
    return fn.generalised_links(df.select("text", fn.dependency(F.col("text")).alias("d")).select("text", "d.*"))


@query("fn_tagged_words", " SELECT * FROM (VALUES (0, 'the', 'DT'), (1, 'and/or', 'CC'), (2, 'dog', 'NN')) AS t(place, word, tag)", graph=False)
def _(g):
    df = g.spark.createDataFrame([("the/DT and/or/CC dog/NN",)], "text string")
    return fn.tagged_words(df)


@query("fn_terms", " SELECT * FROM (VALUES ('dog,mouse@0.5,guinea_pig', 'dog', 1.0::DOUBLE), ('dog,mouse@0.5,guinea_pig', 'mouse', 0.5), ('dog,mouse@0.5,guinea_pig', 'guinea pig', 1.0)) AS t(list, term, weight)", graph=False)
def _(g):
    return g.spark.createDataFrame([("dog,mouse@0.5,guinea_pig", t, w) for t, w in fn.term_list("dog,mouse@0.5,guinea_pig").items()], "list string, term string, weight double")


@query("fn_sentence_compare", " SELECT * FROM (VALUES ('  a  dog. ', 'a dog'), ('A cat.', 'A cat'), ('x', 'x')) AS t(text, bare)", graph=False)
def _(g):
    return g.spark.createDataFrame([("  a  dog. ",), ("A cat.",), ("x",)], "text string").withColumn("bare", fn.bare_sentence(F.col("text")))


@query("fn_first_words", " SELECT text, lower(split_part(text, ' ', 1)) IN ('a', 'an', 'the') AS determined FROM (SELECT surface AS text FROM surfaces)")
def _(g):
    return g.surfaces.select(F.col("surface").alias("text"), fn.begins_with_family(F.col("surface"), ["a", "an", "the"]).alias("determined"))


@query("fn_second_order", " SELECT * FROM (VALUES ('because it rains', 'it rains'), ('i think dogs bark', 'dogs bark'), ('who knows', ''), ('plain', 'plain')) AS t(text, rest)", graph=False)
def _(g):
    rules = [("^because (.*)", 1, False), ("^i think (.*)", 1, False), ("^who knows", 0, True)]
    df = g.spark.createDataFrame([("because it rains",), ("i think dogs bark",), ("who knows",), ("plain",)], "text string")
    return df.withColumn("rest", fn.second_order(F.col("text"), rules))


@query("fn_colour_mix", " SELECT * FROM (VALUES ('sky', 64, 0, 191), ('none', 128, 128, 128)) AS t(word, r, g, b)", graph=False)
def _(g):
    rgb = [("red", 255, 0, 0), ("blue", 0, 0, 255)]
    df = g.spark.createDataFrame([("sky", {"red": 1.0, "blue": 3 ** (1 / 3)}), ("none", {})], "word string, sims map<string,double>")
    return df.select("word", fn.colour_mix(F.col("sims"), rgb).alias("x")).select("word", "x.*")


@query("fn_recode_frames", " SELECT * FROM (VALUES ('for cutting', 'UsedFor', 'cutting'), ('like water', 'SimilarTo', 'water'), ('blue', 'HasProperty', 'blue')) AS t(text2, relation, rest)", graph=False)
def _(g):
    df = g.spark.createDataFrame([("for cutting",), ("like water",), ("blue",)], "text2 string")
    return df.withColumn("r", fn.recoded_prefix(F.col("text2"), "HasProperty", {"for ": "UsedFor", "like ": "SimilarTo"})).select("text2", "r.relation", "r.rest")
