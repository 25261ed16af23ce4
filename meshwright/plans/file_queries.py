"""Queries that write files and read them back, and those that read text sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwright.functions import scalars as fn
from meshwright.operators import exports, extraction, lookups, points
from meshwright.plans.base import query
from meshwright.sources import files, store

_FILL = "replace(replace(replace({0}, '{{%}}', ''), '{{1}}', {1}), '{{2}}', {2})".format
_SENTENCE = _FILL("frame", "trim(surface1)", "trim(surface2)")
_ID = "relation || '|' || c1 || '|' || c2 || '|' || freq || '|' || frame_id"


@query("snk_csv_sentences", f" SELECT {_ID} AS id, creator, score, {_SENTENCE} AS text FROM raws")
def _(g):
    return files.through_csv(exports.raw_rows(g).select("id", "creator", "score", "text"), "sentences")


@query("snk_csv_all_sentences", f" SELECT {_ID} AS id, creator, 'import' AS activity, {_SENTENCE} AS text FROM raws")
def _(g):
    return files.through_csv(exports.raw_rows(g).select("id", "creator", F.lit("import").alias("activity"), "text"), "all-sentences")


@query("snk_csv_concepts", ", n AS (SELECT concept, arg_max(surface, (use_count, surface)) AS name FROM surfaces GROUP BY concept) SELECT text, num_assertions, name AS canonical_name FROM concepts LEFT JOIN n ON concept = text")
def _(g):
    names = lookups.best_surface(g).withColumnRenamed("concept", "text")
    return files.through_csv(g.concepts.select("text", "num_assertions").join(names, "text", "left"), "concepts")


@query("snk_csv_assertions", f" SELECT {_ID} AS id, {_SENTENCE} AS sentence, relation AS relation_type, surface1 AS text1, surface2 AS text2, c1 AS concept1, c2 AS concept2, frame_id, score, creator FROM raws")
def _(g):
    rows = exports.raw_rows(g).select("id", F.col("text").alias("sentence"), F.col("relation").alias("relation_type"), F.col("surface1").alias("text1"), F.col("surface2").alias("text2"), F.col("c1").alias("concept1"), F.col("c2").alias("concept2"), "frame_id", "score", "creator")
    return files.through_csv(rows, "assertions")


@query("snk_csv_frames", " SELECT frame_id, relation AS relation_type, text, goodness FROM frames")
def _(g):
    return files.through_csv(g.frames.select("frame_id", F.col("relation").alias("relation_type"), "text", "goodness"), "frames")


@query("snk_csv_tagged", " SELECT text AS id, replace(text, ' ', '/JJ ') || '/NN' AS text FROM (SELECT DISTINCT p_name AS text FROM part)")
def _(g):
    rows = g.table("part").select(F.col("p_name").alias("id")).distinct()
    return files.through_csv(rows.select("id", F.concat(F.replace("id", F.lit(" "), F.lit("/JJ ")), F.lit("/NN")).alias("text")), "tagged")


@query("snk_tab_edges", " SELECT c1, c2, relation, score FROM useful WHERE c1 <> c2")
def _(g):
    return files.through_csv(g.useful.where("c1 <> c2").select("c1", "c2", "relation", "score"), "edges", sep="\t")


@query("snk_masked_users", " SELECT DISTINCT user_id, '' AS email, '' AS password FROM votes")
def _(g):
    users = g.votes.select("user_id").distinct().withColumns({"email": F.concat("user_id", F.lit("@x")), "password": F.lit("secret")})
    path = store.fresh(g.spark, "users")
    files.masked(users, ["email", "password"]).write.parquet(path)
    return g.spark.read.parquet(path)


@query("snk_documents", " SELECT 'frame' AS model, CAST(frame_id AS VARCHAR) AS pk, relation, text, goodness FROM frames")
def _(g):
    lines = files.documents_out(g.frames.select("frame_id", "relation", "text", "goodness"), "frame", "frame_id")
    path = store.fresh(g.spark, "documents")
    lines.write.text(path)
    return files.documents_in(g.spark, path, "relation string, text string, goodness int")


@query("snk_gml", """, n AS (SELECT c1 AS t FROM useful WHERE c1 <> c2 UNION SELECT c2 FROM useful WHERE c1 <> c2)
SELECT 'node [ id "' || t || '" label "' || t || '" ]' AS line FROM n UNION ALL SELECT 'edge [ source "' || c1 || '" target "' || c2 || '" rel "' || relation || '" score ' || score || ' freq "' || freq || '" ]' FROM useful WHERE c1 <> c2""")
def _(g):
    return files.through_text(exports.gml(g), "gml").select(F.col("value").alias("line"))


@query("snk_json_rows", """ SELECT '{"text":"' || text || '","num_assertions":' || num_assertions || '}' AS value FROM concepts""")
def _(g):
    return files.emitted(g.concepts.select("text", "num_assertions"), "json")


@query("snk_yaml_rows", """ SELECT '--- {"text":"' || text || '","num_assertions":' || num_assertions || '}' AS value FROM concepts""")
def _(g):
    return files.emitted(g.concepts.select("text", "num_assertions"), "yaml")


@query("snk_xml_rows", """ SELECT '<ROW><text>' || text || '</text><num_assertions>' || num_assertions || '</num_assertions></ROW>' AS value FROM concepts""")
def _(g):
    value = F.regexp_replace("value", r">\s+<", "><")
    return files.emitted(g.concepts.select("text", "num_assertions"), "xml").select(value.alias("value"))


@query("snk_n3_frames", """ SELECT '<frame/' || frame_id || '> RelationType <' || relation || '>; FrameText "' || replace(text, '"', '_') || '"; FrameGoodness "' || goodness || '".' AS line FROM frames WHERE frame_id IN (SELECT frame_id FROM raws)""")
def _(g):
    return exports.n3_frames(g)


@query("snk_reified_raws", f""", s AS (SELECT {_ID} AS subject, *, {_SENTENCE} AS sentence FROM raws WHERE assertion_score > 0 AND c1 <> 'HOUSEHOLD' AND c2 <> 'HOUSEHOLD')
SELECT subject, unnest(['type', 'subject', 'predicate', 'object', 'LeftText', 'RightText', 'FrameId', 'Language', 'Creator', 'Score', 'Sentence']) AS predicate,
  unnest(['Statement', c1, relation, c2, surface1, surface2, CAST(frame_id AS VARCHAR), 'en', CAST(creator AS VARCHAR), CAST(score AS VARCHAR), sentence]) AS object FROM s""")
def _(g):
    return exports.reified(g)


@query("snk_coloured_html", """ SELECT text, '<span style="background: rgb(128,128,128)">' || text || '</span>' AS html FROM concepts""")
def _(g):
    none = F.create_map().cast("map<string,double>")
    return exports.coloured(g.concepts.select("text", none.alias("sims")), [("red", 255, 0, 0)])


# Sources


@query("src_statement_lines", " SELECT CAST(user_id AS VARCHAR) AS user, 7 AS frame_id, 'CapableOf' AS relation, '' AS freq, c1 AS text1, c2 AS text2 FROM votes")
def _(g):
    lines = g.votes.select(F.format_string("%d, 7, %s, %s", "user_id", "c1", "c2").alias("value")).unionByName(g.spark.createDataFrame([("",), ("broken, line",)], "value string"))
    return files.statements(files.through_text(lines, "statements"), g.frames)


@query("src_lexicon", " SELECT lower(p_name) AS word, 'NN' AS tag FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS p_name FROM part) UNION ALL SELECT lower(p_name), 'VB' FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS p_name FROM part)", graph=False)
def _(g):
    lines = g.table("part").select(F.concat(F.initcap(F.split("p_name", " ")[1]), F.lit(" NN VB")).alias("value")).distinct()
    return files.lexicon(files.through_text(lines, "lexicon"))


@query("src_rules", " SELECT * FROM (VALUES ('teh', 'the'), ('alot', 'a lot')) AS t(match, replace_with)", graph=False)
def _(g):
    lines = g.spark.createDataFrame([("teh the",), ("alot a lot",), ("",)], "value string")
    return files.rules(files.through_text(lines, "rules"))


@query("fn_autocorrected", " SELECT * FROM (VALUES ('teh dog', 'the dog'), ('alot of tehs', 'a lot of tehs')) AS t(text, fixed)", graph=False)
def _(g):
    df = g.spark.createDataFrame([("teh dog",), ("alot of tehs",)], "text string")
    return df.withColumn("fixed", files.corrected(F.col("text"), [("teh", "the"), ("alot", "a lot")]))


@query("src_colours", " SELECT * FROM (VALUES ('white', 'snow', 10), ('white', 'white', 50), ('red', 'blood', 10), ('red', 'red', 50)) AS t(colour, word, weight)", graph=False)
def _(g):
    path = store.fresh(g.spark, "colours")
    for colour, words in (("white", "snow, white"), ("red", "Blood,red,")):
        g.spark.createDataFrame([(words,)], "value string").coalesce(1).write.text(f"{path}/{colour}")
    return files.colour_contexts(g.spark, [f"{path}/white", f"{path}/red"])


@query("src_stored_matrix", " SELECT relation, c1, c2, score FROM useful WHERE score >= 3")
def _(g):
    return store.stored(g.spark, g.sf_dir, "strong", lambda: g.useful.where("score >= 3").select("relation", "c1", "c2", "score"), ["c1"], g.version)


@query("agg_tag_shares", """WITH w AS (SELECT unnest([lower(split_part(p_name, ' ', 1)) || '/JJ', lower(split_part(p_name, ' ', 2)) || '/NN']) AS t FROM part), p AS (SELECT split_part(t, '/', 1) AS word, split_part(t, '/', 2) AS tag FROM w)
SELECT word, tag, count(*) AS n, round(count(*) / (SELECT count(*) FROM p), 8) AS share FROM p GROUP BY word, tag""", graph=False)
def _(g):
    rows = g.table("part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("/JJ ")), F.lit("/NN")).alias("text"))
    return extraction.tag_probabilities(rows).withColumn("share", F.round("share", 8))


# Sentences


_MATCH = f""", s AS (SELECT DISTINCT {_SENTENCE} || '.' AS sentence FROM raws), b AS (SELECT sentence, trim(sentence, '. ') AS t FROM s),
f AS (SELECT frame_id, goodness, '^' || replace(replace(replace(text, '{{%}}', ''), '{{1}}', '(.+)'), '{{2}}', '(.+)') AS p FROM frames WHERE goodness >= 2),
m AS (SELECT sentence, frame_id, regexp_extract(t, p, 1) AS text1, regexp_extract(t, p, 2) AS text2, row_number() OVER (PARTITION BY sentence ORDER BY goodness DESC, frame_id) AS rn FROM b, f WHERE regexp_matches(t, p))"""


@query("txt_frame_matches", _MATCH + " SELECT s.sentence, frame_id, text1, text2 FROM s LEFT JOIN (SELECT * FROM m WHERE rn = 1) m USING (sentence)")
def _(g):
    sentences = points.lookup_raws(g.raws).select(F.concat("sentence", F.lit(".")).alias("sentence")).distinct()
    return extraction.frame_matches(sentences, g.frames)


@query("txt_statements")
def _(g):
    sentences = points.lookup_raws(g.raws.where("goodness >= 3")).select("sentence").distinct()
    return extraction.statements(sentences)


@query("txt_parse_conversations")
def _(g):
    return extraction.parsed_once(g.table("conversations").select(F.substring_index("text", ". ", 1).alias("sentence")).where("sentence is not null"))


@query("snk_parsed_sentences")
def _(g):
    rows = extraction.parsed_once(points.lookup_raws(g.raws.where("goodness >= 4 and relation = 'PartOf'")).select("sentence"))
    path = store.fresh(g.spark, "parsed")
    rows.write.json(path)
    return g.spark.read.schema(rows.schema).json(path)
