"""Scalar functions, text sources and counts over texts that the given tables hold or that are derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwright.functions import scalars as fn
from meshwright.operators import exports, extraction, lookups, points, writes
from meshwright.plans.base import query
from meshwright.sources import files, store

_FILL = "replace(replace(replace({0}, '{{%}}', ''), '{{1}}', {1}), '{{2}}', {2})".format
_SENTENCE = _FILL("frame", "trim(surface1)", "trim(surface2)")


# Words of the sentences that the raw assertions say


@query(
    "fn_sentence_adverbs",
    f""", s AS (SELECT DISTINCT {_SENTENCE} AS sentence FROM raws), w AS (SELECT sentence, unnest(regexp_split_to_array(lower(sentence), '\\s+')) AS w FROM s),
v AS (SELECT sentence, min(CASE w WHEN 'rarely' THEN -2 WHEN 'usually' THEN 8 WHEN 'cannot' THEN -5 WHEN 'not' THEN -5 WHEN 'always' THEN 10 WHEN 'sometimes' THEN 4 END) AS v FROM w GROUP BY sentence)
SELECT sentence, CAST(coalesce(v, 5) AS INTEGER) AS value, text AS freq FROM v JOIN frequencies f ON f.value = coalesce(v, 5)""",
)
def _(g):
    said = points.lookup_raws(g.raws).select("sentence").distinct().withColumn("value", fn.adverb_value(F.col("sentence")))
    return said.withColumn("freq", fn.frequency_text(F.col("value")))


@query("fn_former_relations", """, o AS (SELECT CASE relation WHEN 'AtLocation' THEN 'LocationOf' WHEN 'HasProperty' THEN 'PropertyOf' ELSE relation END || CASE WHEN value < 0 THEN 'Inverse' ELSE '' END AS old, relation, value FROM assertions)
SELECT old, relation AS name, value < 0 AS reverse, count(*) AS n FROM o GROUP BY ALL""")
def _(g):
    old = F.when(F.col("relation") == "AtLocation", "LocationOf").when(F.col("relation") == "HasProperty", "PropertyOf").otherwise(F.col("relation"))
    rows = g.assertions.select(F.concat(old, F.when(F.col("value") < 0, "Inverse").otherwise("")).alias("old"))
    return rows.withColumn("r", fn.renamed_relation(F.col("old"))).groupBy("old", "r.name", "r.reverse").agg(F.count("*").alias("n"))


_LINK = "CASE WHEN p_partkey % 4 = 0 THEN 'prep_of' WHEN p_partkey % 4 = 1 THEN 'conj_and' WHEN p_partkey % 4 = 2 THEN 'prepc_by' ELSE 'amod' END"


@query(
    "fn_part_dependencies",
    f"""WITH d AS (SELECT p_partkey, {_LINK} AS linktype, split_part(p_name, ' ', 2) AS word1, p_size AS index1, split_part(p_name, ' ', 1) AS word2, 1 AS index2 FROM part)
SELECT * FROM d UNION ALL SELECT p_partkey, CASE linktype WHEN 'conj_and' THEN 'conj' ELSE 'prep' END, word1, index1, word2, index2 FROM d WHERE linktype <> 'amod'""",
    graph=False,
)
def _(g):
    key = F.col("p_partkey") % 4
    link = F.when(key == 0, "prep_of").when(key == 1, "conj_and").when(key == 2, "prepc_by").otherwise("amod")
    word = F.split("p_name", " ")
    text = F.format_string("%s(%s-%d, %s-1')", link, word[1], "p_size", word[0])
    rows = g.table("part").select("p_partkey", fn.dependency(text).alias("d")).select("p_partkey", "d.*")
    return fn.generalised_links(rows)


@query("fn_tagged_parts", """SELECT p_partkey, CAST(i AS INTEGER) AS place, CASE i WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN 'and/or' ELSE split_part(p_name, ' ', 2) END AS word, CASE i WHEN 0 THEN 'JJ' WHEN 1 THEN 'CC' ELSE 'NN' END AS tag FROM part, range(3) AS r(i)""", graph=False)
def _(g):
    word = F.split("p_name", " ")
    rows = g.table("part").select("p_partkey", F.concat(word[0], F.lit("/JJ and/or/CC "), word[1], F.lit("/NN")).alias("text"))
    each = rows.select("p_partkey", F.posexplode(F.split("text", " ")).alias("place", "t"))
    last = "^(.*)/([^/]*)$"
    return each.select("p_partkey", "place", F.regexp_extract("t", last, 1).alias("word"), F.regexp_extract("t", last, 2).alias("tag"))


@query("fn_bare_lines", r"""WITH l AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, regexp_replace(replace(line, '  ', ' '), '^[. ]+|[. ]+$', '', 'g') AS bare FROM l""", graph=False)
def _(g):
    line = g.table("documents").select(F.explode(F.split("text", "\n")).alias("line")).distinct()
    return line.withColumn("bare", fn.bare_sentence(F.col("line")))


_RULES = [("^who ", 0, True), ("^(a|the) (.*)", 2, False), ("^[Nn]ation_(.*)", 1, False), ("(.*) (anvil|bolt)$", 1, False)]


@query("fn_second_order_surfaces", r""", a AS (SELECT surface, CASE WHEN regexp_matches(surface, '^who ') THEN '' ELSE surface END AS t FROM surfaces),
b AS (SELECT surface, CASE WHEN regexp_matches(t, '^(a|the) (.*)') THEN regexp_extract(t, '^(a|the) (.*)', 2) ELSE t END AS t FROM a),
c AS (SELECT surface, CASE WHEN regexp_matches(t, '^[Nn]ation_(.*)') THEN regexp_extract(t, '^[Nn]ation_(.*)', 1) ELSE t END AS t FROM b)
SELECT surface, CASE WHEN regexp_matches(t, '(.*) (anvil|bolt)$') THEN regexp_extract(t, '(.*) (anvil|bolt)$', 1) ELSE t END AS rest FROM c""")
def _(g):
    return g.surfaces.select("surface", fn.second_order(F.col("surface"), _RULES).alias("rest"))


@query("fn_recoded_raws", """, r AS (SELECT relation, c1, CASE WHEN length(c1) % 3 = 0 THEN 'for ' WHEN length(c1) % 3 = 1 THEN 'like ' ELSE '' END || c2 AS text2, c2 FROM useful WHERE relation = 'HasProperty')
SELECT c1, text2, CASE WHEN length(c1) % 3 = 0 THEN 'UsedFor' WHEN length(c1) % 3 = 1 THEN 'SimilarTo' ELSE 'HasProperty' END AS relation, c2 AS rest FROM r""")
def _(g):
    n = F.length("c1") % 3
    rows = g.useful.where("relation = 'HasProperty'").select("c1", F.concat(F.when(n == 0, "for ").when(n == 1, "like ").otherwise(""), "c2").alias("text2"))
    return rows.withColumn("r", fn.recoded_prefix(F.col("text2"), "HasProperty", {"for ": "UsedFor", "like ": "SimilarTo"})).select("c1", "text2", "r.relation", "r.rest")


@query("wrt_unswitched_raws", """, r AS (SELECT c1, c2, length(c1) % 2 = 0 AS turned FROM useful WHERE relation = 'IsA')
SELECT c1, c2, 'the ' || c1 AS text1, c2 AS text2, turned AND lower(c1) <> lower(c2) AS swapped FROM r WHERE c1 NOT LIKE '% % %'""")
def _(g):
    rows = g.useful.where("relation = 'IsA' and c1 not like '% % %'").select("c1", "c2", (F.length("c1") % 2 == 0).alias("turned"))
    the = F.concat(F.lit("the "), "c1")
    said = rows.select("c1", "c2", F.when(F.col("turned"), F.col("c2")).otherwise(the).alias("text1"), F.when(F.col("turned"), the).otherwise(F.col("c2")).alias("text2"), F.col("c1").alias("parsed1"), F.col("c2").alias("parsed2"))
    return writes.unswitched(said).select("c1", "c2", "text1", "text2", "swapped")


@query("wrt_templated_votes", " SELECT user_id, c1 AS text1, c2 AS text2, CASE WHEN vote < 0 THEN 'not' ELSE '' END AS freq, vote FROM votes")
def _(g):
    rows = g.votes.select("user_id", F.lit("CapableOf").alias("relation"), F.col("vote").alias("polarity"), F.lit("{1} can make {2}").alias("frame"), F.col("c1").alias("text1"), F.col("c2").alias("text2"), (F.col("vote") * 4).alias("rating"), F.lit(1).cast("long").alias("at"))
    return writes.templated(rows).select("user_id", "text1", "text2", "freq", "vote")


# Text sources


@query("src_part_rules", "SELECT DISTINCT split_part(p_name, ' ', 1) AS match, split_part(p_name, ' ', 2) || ' ' || p_brand AS replace_with FROM part", graph=False)
def _(g):
    lines = g.table("part").select(F.concat_ws(" ", "p_name", "p_brand").alias("value")).distinct()
    return files.rules(files.through_text(lines, "rules"))


@query("src_part_colours", """WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS colour, unnest([p_name, split_part(p_name, ' ', 1)]) AS word FROM part WHERE split_part(p_name, ' ', 1) IN ('blue', 'red', 'green'))
SELECT colour, word, CASE WHEN word = colour THEN 50 ELSE 10 END AS weight FROM w""", graph=False)
def _(g):
    """A folder of words for each colour, the colour's own among them."""
    path, names = store.fresh(g.spark, "colours"), ["blue", "red", "green"]
    parts = g.table("part").select("p_name").distinct()
    for c in names:
        mine = parts.where(F.split("p_name", " ")[0] == c)
        mine.agg(F.concat(F.lit(f" {c.title()}, "), F.array_join(F.sort_array(F.collect_list("p_name")), ", ")).alias("value")).write.text(f"{path}/{c}")
    found = files.colour_contexts(g.spark, [f"{path}/{c}" for c in names])
    # a colour that no part has is a file of its own name alone
    there = parts.select(F.split("p_name", " ")[0].alias("colour")).distinct()
    return found.join(there, "colour", "left_semi").select("colour", "word", "weight").distinct()


# Counts


@query("agg_language_sentences", "WITH l AS (SELECT DISTINCT lang, unnest(string_split(text, chr(10))) AS sentence FROM documents) SELECT lang AS id, count(*) AS sentence_count FROM l WHERE trim(sentence) <> '' GROUP BY lang", graph=False)
def _(g):
    """Each language's distinct sentences, a line being one."""
    said = g.table("documents").select("lang", F.explode(F.split("text", "\n")).alias("sentence")).distinct()
    return said.where("trim(sentence) <> ''").groupBy(F.col("lang").alias("id")).agg(F.count("*").alias("sentence_count"))


_TAGGED = """WITH t AS (SELECT p_partkey * 10 + i AS pos, lower(CASE i WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE 'Rarely' END WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN 'run' ELSE '''s' END) AS word,
  CASE i WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'JJ' ELSE 'RB' END WHEN 1 THEN 'NN' WHEN 2 THEN CASE WHEN p_size % 5 = 0 THEN 'MD' ELSE 'VB' END ELSE 'POS' END AS tag FROM part, range(4) AS r(i)),
x AS (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS word, unnest(['NN', 'RB']) AS tag FROM part),
k AS (SELECT word, min(pos) FILTER (WHERE tag NOT IN ('RB', 'MD', 'DO')) AS first FROM t GROUP BY word),
m AS (SELECT k.word, count(*) FILTER (WHERE tag IN ('RB', 'MD', 'DO') AND (first IS NULL OR pos < first)) + CASE WHEN first IS NULL AND k.word NOT IN (SELECT word FROM x) THEN 0 ELSE 1 END AS n FROM k JOIN t ON t.word = k.word GROUP BY k.word, first
  UNION ALL SELECT DISTINCT word, 1 FROM x WHERE word NOT IN (SELECT word FROM k)),
o AS (SELECT word, tag FROM t WHERE tag NOT IN ('RB', 'MD', 'DO') UNION ALL SELECT * FROM x),
total AS (SELECT (SELECT count(*) FROM o) + 0.01 * (SELECT sum(n) FROM m) AS total),
c AS (SELECT word, tag, count(*)::DOUBLE AS n FROM o GROUP BY word, tag UNION ALL SELECT word, 'NN', 0.009 FROM m UNION ALL SELECT word, 'VB', 0.001 FROM m)"""


@query("agg_tag_probabilities", _TAGGED + " SELECT word, tag, round(sum(n) / any_value(total), 10) AS share FROM c, total WHERE word <> '''s' GROUP BY word, tag UNION ALL SELECT '''s', 'POS', round(5000 / total, 10) FROM total", graph=False)
def _(g):
    word = F.split("p_name", " ")
    odd = F.col("p_size") % 2 == 1
    said = [F.when(odd, "Rarely/RB").otherwise(F.concat(word[0], F.lit("/JJ"))), F.concat(word[1], F.lit("/NN")), F.when(F.col("p_size") % 5 == 0, "run/MD").otherwise("run/VB"), F.lit("'s/POS")]
    tagged = g.table("part").select((F.col("p_partkey") * 10).alias("at"), F.concat_ws(" ", *said).alias("text"))
    lexicon = g.table("part").select(F.lower(word[1]).alias("word"), F.explode(F.array(F.lit("NN"), F.lit("RB"))).alias("tag")).distinct()
    return extraction.unigram_probabilities(tagged, lexicon).withColumn("share", F.round("share", 10))


@query(
    "flt_vocabulary",
    """, n AS (SELECT concept, arg_max(surface, (use_count, surface)) AS name FROM surfaces GROUP BY concept), c AS (SELECT text, name FROM concepts JOIN n ON concept = text WHERE num_assertions > 0),
d AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS w FROM part WHERE p_size < 30),
a AS (SELECT text, unnest(string_split(text, ' ')) AS w FROM c), b AS (SELECT text, unnest(string_split(name, ' ')) AS w FROM c),
bad AS (SELECT text FROM a LEFT JOIN (SELECT text AS known FROM c) ON known = w WHERE known IS NULL UNION SELECT text FROM b LEFT JOIN d ON d.w = lower(b.w) WHERE d.w IS NULL AND lower(b.w) NOT IN ('a', 'the'))
SELECT c.text, name FROM c LEFT JOIN bad ON bad.text = c.text WHERE bad.text IS NULL""",
)
def _(g):
    dictionary = g.table("part").where("p_size < 30").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return points.vocabulary(g, dictionary)


@query(
    "snk_csv_dated_sentences",
    f""", f AS (SELECT c1, c2, min(l_shipdate) AS created_on, CASE WHEN arg_min(vote, ({", ".join(["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag"])})) > 0 THEN 'statement' ELSE 'denial' END AS activity FROM vote_log GROUP BY c1, c2)
SELECT relation || '|' || r.c1 || '|' || r.c2 || '|' || freq || '|' || frame_id AS id, creator, CASE WHEN relation = 'CapableOf' THEN created_on END AS created_on, CASE WHEN relation = 'CapableOf' THEN activity ELSE 'import' END AS activity, {_SENTENCE} AS text FROM raws r LEFT JOIN f ON f.c1 = r.c1 AND f.c2 = r.c2""",
)
def _(g):
    return files.through_csv(exports.dated_sentences(g), "dated-sentences")


@query(
    "prj_addresses",
    """, u AS (SELECT *, '/en/' AS base FROM useful) SELECT 'assertion' AS kind, '/en/assertion/' || replace(url_encode(relation || '|' || c1 || '|' || c2 || '|' || freq), '%20', '+') || '/' AS url, relation || '(' || c1 || ', ' || c2 || ')[' || freq || ']' AS text FROM useful
UNION ALL SELECT 'raw_assertion', '/en/raw_assertion/' || replace(url_encode(relation || '|' || c1 || '|' || c2 || '|' || freq || '|' || frame_id), '%20', '+') || '/', 'en: (''' || surface1 || ''' ' || relation || ' ''' || surface2 || ''') s=' || score FROM raws
UNION ALL SELECT 'concept', '/en/concept/' || replace(url_encode(text), '%20', '+') || '/', '<en: ' || text || '>' FROM concepts""",
)
def _(g):
    return exports.addresses(g)
