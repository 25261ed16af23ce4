"""Queries of changes between versions, work in batches, block documents and coloured texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwright.operators import batches, colours, exports, matrix, points, versions, voting
from meshwright.plans.base import query
from meshwright.sources import files, store
from meshwright.sources.graph import ORDER

USER_VOTE = ["user_id", "c1", "c2"]
_EARLY = "TIMESTAMP '1995-01-01 00:00:00'"
_LAST = "(SELECT user_id, c1, c2, vote FROM (SELECT *, row_number() OVER (PARTITION BY user_id, c1, c2 ORDER BY {order}) AS rn FROM vote_log WHERE {where}) WHERE rn = 1)"
_ORDER = ", ".join(c + " DESC" for c in ORDER)
_STATES = f", b AS {_LAST.format(order=_ORDER, where=f'l_shipdate < {_EARLY}')}, a AS {_LAST.format(order=_ORDER, where='right(c1, 1) <> ' + chr(39) + '7' + chr(39))}"


def _state(g, where: str):
    last = F.max_by("vote", F.struct(*ORDER))
    return g.vote_log.where(where).groupBy(*USER_VOTE).agg(last.alias("vote"))


def _states(g):
    """The votes of the first years as a stamped state, and later votes without some suppliers'."""
    before = versions.stamped(_state(g, f"l_shipdate < {_EARLY}"), USER_VOTE, F.lit("2001-01-01").cast("timestamp_ntz"))
    return before, _state(g, "right(c1, 1) <> '7'")


@query("wrt_changes", _STATES + " SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.c1, b.c1) AS c1, coalesce(a.c2, b.c2) AS c2, CASE WHEN b.vote IS NULL THEN 'inserted' WHEN a.vote IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id AND a.c1 = b.c1 AND a.c2 = b.c2 WHERE a.vote IS DISTINCT FROM b.vote")
def _(g):
    return versions.changes(*_states(g), USER_VOTE)


@query(
    "wrt_stamps",
    _STATES
    + """ SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.c1, b.c1) AS c1, coalesce(a.c2, b.c2) AS c2, coalesce(a.vote, b.vote) AS vote,
CASE WHEN b.vote IS NULL THEN TIMESTAMP '2002-02-02' ELSE TIMESTAMP '2001-01-01' END AS created, CASE WHEN a.vote IS NULL OR a.vote = b.vote THEN TIMESTAMP '2001-01-01' ELSE TIMESTAMP '2002-02-02' END AS updated
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.c1 = b.c1 AND a.c2 = b.c2""",
)
def _(g):
    return versions.saved(*_states(g), USER_VOTE, F.lit("2002-02-02").cast("timestamp_ntz")).drop("digest")


@query("wrt_batched_scores", " SELECT c1, c2, CAST(sum(vote) AS BIGINT) AS score, count(vote) AS n_votes FROM votes GROUP BY c1, c2")
def _(g):
    part = F.pmod(F.xxhash64("c1", "c2"), F.lit(4))
    return batches.in_batches(g.votes, part, lambda rows: voting.scores(rows, ["c1", "c2"]), "scores")[0]


@query("agg_batch_progress", " SELECT CAST(user_id % 4 AS INTEGER) AS batch, 'done' AS status, 'voters' AS remarks, count(*) AS progress_num, count(*) AS progress_den FROM votes GROUP BY user_id % 4")
def _(g):
    work = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"))
    return batches.in_batches(g.votes, F.col("user_id") % 4, work, "voters")[1].drop("created", "updated")


@query("src_block_documents", "SELECT 'document' AS model, CAST(doc_id AS VARCHAR) AS pk, text, lang, source, n_chars FROM documents", graph=False)
def _(g):
    return files.through_blocks(g.table("documents"), "document", "doc_id")


#: A colour for each language of the documents.
_COLOURS = {"de": "black", "en": "red", "es": "yellow", "fr": "blue"}


def _mix(v: str) -> str:
    """r, g, b of a list of four counts, by hand, as one step a colour."""
    n = f"sqrt({' + '.join(f'{v}[{i}] * {v}[{i}]' for i in range(1, 5))})"
    s = [f"({v}[{i}] / {n})" for i in range(1, 5)]
    cube = [f"({x} * {x} * {x})" for x in s]
    total = "(" + " + ".join(cube) + ")"
    out = []
    for k in range(3):
        step = "0"
        for c, name in zip(cube, _COLOURS.values()):
            step = f"greatest(0, least(255, CAST(trunc({c} / {total} * {float(colours.RGB[name][k])} + {step}) AS INTEGER)))"
        out.append(f"CASE WHEN {v} IS NULL THEN 128 ELSE {step} END")
    return " || ',' || ".join(out)


@query(
    "snk_coloured_documents",
    f"""WITH l AS (SELECT doc_id, i AS line, string_split(string_split(text, chr(10))[i], ' ') AS w FROM documents, range(1, 100000) AS r(i) WHERE i <= len(string_split(text, chr(10)))),
w AS (SELECT doc_id, line, j AS pos, w[j] AS word FROM l, range(1, 100000) AS r(j) WHERE j <= len(w)),
n AS (SELECT lower(word) AS concept, lang, count(DISTINCT w.doc_id) AS n FROM w JOIN documents d ON d.doc_id = w.doc_id WHERE word <> '' GROUP BY 1, 2),
v AS (SELECT concept, [{", ".join(f"coalesce(sum(n) FILTER (WHERE lang = '{x}'), 0)::DOUBLE" for x in _COLOURS)}] AS v FROM n WHERE lang IN ('de', 'en', 'es', 'fr') GROUP BY concept),
m AS (SELECT doc_id, line, pos, word, v FROM w LEFT JOIN v ON lower(word) = concept),
b AS (SELECT doc_id, line, string_agg(CASE WHEN v IS NOT NULL THEN '<span style="background-color: rgb(' || ({_mix("v")}) || ')">' || word || '</span>' ELSE word END, ' ' ORDER BY pos) AS words,
  CASE WHEN count(v) > 0 THEN [sum(v[1]), sum(v[2]), sum(v[3]), sum(v[4])] END AS t FROM m GROUP BY doc_id, line)
SELECT doc_id, string_agg('<div style="background-color: rgb(' || ({_mix("t")}) || '); padding: 1ex;">' || words || '</div>', chr(10) ORDER BY line) AS html FROM b GROUP BY doc_id""",
    graph=False,
)
def _(g):
    """A word's vector counts the documents of each language that hold it."""
    docs = g.table("documents").select("doc_id", "text", "lang")
    word = F.explode(F.array_distinct(F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda w: F.lower(w)))).alias("concept")
    held = docs.where(F.col("lang").isin(list(_COLOURS))).select("lang", word).where("concept <> ''")
    v = F.array(*[F.count_if(F.col("lang") == x).cast("double") for x in _COLOURS]).alias("v")
    units = [(c, [float(i == j) for j in range(len(_COLOURS))]) for i, c in enumerate(_COLOURS.values())]
    return colours.coloured_texts(docs, held.groupBy("concept").agg(v), units)


@query("mat_coloured_concepts")
def _(g):
    """Concepts' colours by the blend of the graph with the colours that stand in parts' names."""
    names = g.table("part").select(F.col("p_name").alias("word"), F.split("p_name", " ")[0].alias("colour")).distinct()
    vectors, found = colours.learned(matrix.build_matrix(matrix.quads(g)), names.where(F.col("colour").isin(list(colours.RGB))), k=100)
    return colours.coloured_concepts(vectors, found)


_SIDE = "(SELECT relation, c{0}, surface{0} AS said{0} FROM (SELECT relation, c{0}, surface{0}, row_number() OVER (PARTITION BY relation, c{0} ORDER BY score DESC, frame_id, surface{0}) AS rn FROM raws) WHERE rn = 1)"
_WORDED = f""", p AS (SELECT c1, relation, c2 FROM useful UNION SELECT c2, relation, c1 FROM useful),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY goodness >= 3 DESC, goodness DESC, frame_id) AS rn FROM frames) WHERE rn = 1),
n AS (SELECT concept, arg_max(surface, (use_count, surface)) AS name FROM surfaces GROUP BY concept),
z AS (SELECT p.c1, p.relation, p.c2, frame_id, f.text AS frame, coalesce(said1, n1.name, p.c1) AS text1, coalesce(said2, n2.name, p.c2) AS text2, question_yn FROM p JOIN f ON f.relation = p.relation
  LEFT JOIN {_SIDE.format(1)} s1 ON s1.relation = p.relation AND s1.c1 = p.c1 LEFT JOIN {_SIDE.format(2)} s2 ON s2.relation = p.relation AND s2.c2 = p.c2
  LEFT JOIN n n1 ON n1.concept = p.c1 LEFT JOIN n n2 ON n2.concept = p.c2)"""


@query("nl_proposition_wording", _WORDED + " SELECT c1, relation, c2, frame_id, frame, text1, text2 FROM z")
def _(g):
    return points.proposition_wording(g, points.propositions(g)).drop("question_yn")


@query("nl_proposition_questions", _WORDED + " SELECT c1, relation, c2, replace(replace(replace(coalesce(question_yn, frame || '?'), '{%}', ''), '{1}', '[[' || text1 || ']]'), '{2}', '[[' || text2 || ']]') AS question FROM z")
def _(g):
    return points.proposition_questions(g, points.propositions(g))


@query(
    "jn_rated_objects",
    """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY relation, c1, c2, freq ORDER BY score DESC, frame_id) AS rn FROM raws) WHERE rn = 1 AND relation = 'CapableOf'),
o AS (SELECT c1, c2, 'assertion' AS kind, relation || '|' || c1 || '|' || c2 || '|' || freq AS object, relation || '(' || c1 || ', ' || c2 || ')[' || freq || ']' AS words, score FROM assertions WHERE relation = 'CapableOf'
  UNION ALL SELECT c1, c2, 'raw_assertion', relation || '|' || c1 || '|' || c2 || '|' || freq || '|' || frame_id, replace(replace(replace(frame, '{%}', ''), '{1}', trim(surface1)), '{2}', trim(surface2)), score FROM best)
SELECT kind, object, user_id, vote, CASE WHEN vote = 1 THEN 'For' ELSE 'Against' END AS label, words, score FROM votes v JOIN o ON o.c1 = v.c1 AND o.c2 = v.c2""",
)
def _(g):
    return points.rated_objects(g, "For,Against")


@query("fn_confirm_messages", """ SELECT DISTINCT c1, CASE WHEN vote = 1 THEN 'Confirm <strong>up</strong> vote for <strong>' || c1 || ' &amp; &lt;others&gt;</strong>.' ELSE 'Confirm clearing your vote for <strong>' || c1 || ' &amp; &lt;others&gt;</strong>.' END AS message FROM votes""")
def _(g):
    named = g.votes.select("c1", F.when(F.col("vote") == 1, "up").otherwise("clear").alias("d")).distinct()
    return named.select("c1", points.confirm_message(F.concat("c1", F.lit(" & <others>")), F.col("d")).alias("message"))


_TABLES = {
    "vote": ("votes", "c1,c2,user_id,vote"),
    "raw_assertion": ("raws", "assertion_score,c1,c2,creator,frame,frame_id,freq,goodness,relation,score,surface1,surface2,value"),
    "frame": ("frames", "frame_id,freq,goodness,question_yn,relation,text"), "surface_form": ("surfaces", "concept,surface,use_count"), "assertion": ("assertions", "c1,c2,freq,relation,score,value"),
    "relation": ("relations", "name"), "frequency": ("frequencies", "text,value"), "concept": ("concepts", "num_assertions,text,visible,words"), "language": ("languages", "id,name,sentence_count"),
    "sentence": ("(SELECT DISTINCT replace(replace(replace(frame, '{%}', ''), '{1}', trim(surface1)), '{2}', trim(surface2)), creator, score FROM raws)", "creator,score,text"),
    "user": ("(SELECT DISTINCT user_id FROM votes)", "date_joined,email,first_name,is_active,is_staff,is_superuser,last_login,last_name,password,user_id,username"),
    "content_type": ("(VALUES (1), (2), (3))", "name"), "activity": ("(VALUES (1), (2))", "name"), "batch": ("(SELECT 1 WHERE false)", "batch,created,progress_den,progress_num,remarks,status,updated"),
}


@query("snk_dump", " " + " UNION ALL ".join(f"""SELECT '{name}' AS "table", count(*) AS rows, '{columns}' AS columns FROM {source} AS t""" for name, (source, columns) in _TABLES.items()))
def _(g):
    return exports.dump(g, store.fresh(g.spark, "dump"))


@query("snk_dump_users", " SELECT DISTINCT user_id, 'user_' || user_id AS username, '' AS email, 'X' AS password, TIMESTAMP '1969-12-31 19:00:00' AS last_login, false AS is_staff FROM votes")
def _(g):
    path = store.fresh(g.spark, "users")
    exports.tables(g)["user"].write.parquet(path)
    back = g.spark.read.parquet(path)
    return back.select("user_id", "username", "email", "password", F.col("last_login").cast("timestamp_ntz").alias("last_login"), "is_staff")
