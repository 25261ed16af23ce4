"""Queries of matrix similarity and traversal."""

from __future__ import annotations

from pyspark.sql import functions as F

from meshwright.functions import scalars as fn
from meshwright.operators import matrix, traversal
from meshwright.plans.base import query

HUB = "Supplier#000000001"


def _spread_sql(weight: str, hub: str = HUB) -> str:
    return f""", e AS (SELECT DISTINCT relation, c1, c2 FROM useful), d AS (SELECT c1 AS c2, count(*) AS d FROM e GROUP BY c1),
st AS (SELECT e.c1, e.c2, 0.5 * exp(-power(ln(coalesce(d, 0) + 5) / ln(5) - 2.5, 2) / 2) / sqrt(2 * pi()) * ({weight}) AS f FROM e LEFT JOIN d ON e.c2 = d.c2),
v1 AS (SELECT c2 AS node, f AS s FROM st WHERE c1 = '{hub}' AND f > 0 ORDER BY s DESC, node LIMIT 500),
v2 AS (SELECT c2 AS node, s * f AS s FROM v1 JOIN st ON node = c1 WHERE f > 0 ORDER BY s DESC, node LIMIT 500),
v AS (SELECT * FROM v1 UNION ALL SELECT * FROM v2)
SELECT node, round(1 - exp(sum(ln(1 - s))), 6) AS score FROM v WHERE node <> '{hub}' GROUP BY node ORDER BY score DESC, node LIMIT 200"""


# the weights stand in the SQL by hand, so that a wrong constant shows
_DEFAULT = "CASE relation WHEN 'AtLocation' THEN 0.9 WHEN 'CapableOf' THEN 0.8 WHEN 'DefinedAs' THEN 1.0 WHEN 'HasProperty' THEN 1.0 WHEN 'IsA' THEN 0.9 WHEN 'MadeOf' THEN 0.7 WHEN 'PartOf' THEN 1.0 ELSE 0 END"
_KINDS = {
    "spatial": "CASE relation WHEN 'AtLocation' THEN 1.0 WHEN 'ConceptuallyRelatedTo' THEN 0.5 ELSE 0 END",
    "details": "CASE relation WHEN 'MadeOf' THEN 1.0 WHEN 'PartOf' THEN 1.0 WHEN 'HasProperty' THEN 0.9 ELSE 0 END",
    "consequences": "CASE relation WHEN 'CapableOf' THEN 0.4 WHEN 'UsedFor' THEN 0.4 ELSE 0 END",
    "affective": "CASE relation WHEN 'Desires' THEN 1.0 ELSE 0 END",
}


@query("gra_spread", _spread_sql(_DEFAULT))
def _(g):
    return traversal.spread(g, {HUB: 1.0})


for _kind, _sql in _KINDS.items():
    _from = "blue anvil" if _kind == "details" else HUB

    @query(f"gra_project_{_kind}", _spread_sql(_sql, _from))
    def _(g, kind=_kind, start=_from):
        return traversal.project(g, kind, {start: 1.0})


def _far_sql(forward: str, reverse: str, origin: str, steps: int = 14, least: float = 1e-5) -> str:
    """More steps than any visit of `least` can take, as a way passes at most a fifth on."""
    discount = "0.5 * exp(-power(ln(coalesce(d, 0) + 5) / ln(5) - 2.5, 2) / 2) / sqrt(2 * pi())"
    parts = [f""", e AS (SELECT DISTINCT relation, c1, c2 FROM useful), o AS (SELECT c1 AS n, count(*) AS d FROM e GROUP BY c1), i AS (SELECT c2 AS n, count(*) AS d FROM e GROUP BY c2),
st AS MATERIALIZED (SELECT c1 AS a, c2 AS b, {discount} * ({forward}) AS f FROM e LEFT JOIN o ON n = c2 WHERE ({forward}) > 0 UNION ALL SELECT c2, c1, {discount} * ({reverse}) FROM e LEFT JOIN i ON n = c1 WHERE ({reverse}) > 0),
v0 AS (SELECT '{origin}' AS node, 1.0::DOUBLE AS s)"""]  # fmt: skip
    for k in range(steps):
        parts.append(f"v{k + 1} AS MATERIALIZED (SELECT b AS node, s * f AS s FROM v{k} JOIN st ON a = node WHERE s * f >= {least} ORDER BY 2 DESC, 1 LIMIT 500)")
    every = " UNION ALL ".join(f"SELECT * FROM v{k + 1}" for k in range(steps))
    return ", ".join(parts) + f", v AS ({every}) SELECT node, round(1 - exp(sum(ln(1 - s))), 6) AS score FROM v WHERE node <> '{origin}' GROUP BY node ORDER BY score DESC, node LIMIT 200"


_BACK = "CASE relation WHEN 'CapableOf' THEN 0.5 WHEN 'AtLocation' THEN 0.9 WHEN 'PartOf' THEN 1.0 ELSE 0 END"


@query("gra_spread_out", _far_sql(_DEFAULT, "0", HUB))
def _(g):
    return traversal.spread_out(g, {HUB: 1.0})


@query("gra_spread_both_ways", _far_sql(_DEFAULT, _BACK, "blue anvil"))
def _(g):
    back = {"CapableOf": 0.5, "AtLocation": 0.9, "PartOf": 1.0}
    return traversal.spread_out(g, {"blue anvil": 1.0}, weights=(traversal.WEIGHTS, back))


_WHERE = "CASE relation WHEN 'AtLocation' THEN 1.0 ELSE 0 END"


@query("gra_project_places", _far_sql(_WHERE, _WHERE, "NATION_3"))
def _(g):
    """The spatial projection in both directions: what is at a place, and what else is where that is."""
    return traversal.spread_out(g, {"NATION_3": 1.0}, weights=(traversal.PROJECTIONS["spatial"], {"AtLocation": 1.0}))


@query("gra_activate")
def _(g):
    return traversal.activate(g, {HUB: 1.0})


def _related_sql(root: str, expansions: int = 101, levels: int = 7) -> str:
    """More levels than the graph is deep; a level halves a node's weight with each further part."""
    parts = [f""", e AS MATERIALIZED (SELECT * FROM (SELECT c1 AS parent, relation, c2 AS node, freq, value / 10.0 * log2(greatest(score + 1, 1)) AS v, {_DEFAULT} AS w FROM useful) WHERE v > 0 AND w > 0),
f1 AS (SELECT '{root}' AS node, 0 AS place, 1.0::DOUBLE AS pw), s1 AS (SELECT node FROM f1), k0 AS (SELECT '' AS node, 0.0::DOUBLE AS w, 0 AS lev WHERE false)"""]  # fmt: skip
    fold = "list_reduce({}, lambda a, b: 0.5 * b + 0.5 * a)"
    for n in range(1, levels + 1):
        share = f"(1.0 / (2 * ({n} - k.lev + 1)))"
        parts.append(f"""r{n} AS (SELECT e.node, place, relation, freq, v / {n} * pw * w AS x FROM e JOIN f{n} ON e.parent = f{n}.node),
m{n} AS MATERIALIZED (SELECT node, list(x ORDER BY place, relation, freq, x) AS xs, min(struct_pack(place := place, relation := relation, freq := freq, x := x)) AS first FROM r{n} GROUP BY node),
k{n} AS MATERIALIZED (SELECT coalesce(m.node, k.node) AS node, CASE WHEN m.node IS NULL THEN k.w WHEN k.node IS NULL THEN {fold.format("xs")} ELSE {fold.format(f"list_prepend({share} * xs[1] + (1 - {share}) * k.w, xs[2:])")} END AS w,
  CASE WHEN m.node IS NULL THEN k.lev ELSE {n} END AS lev FROM k{n - 1} k FULL JOIN m{n} m ON m.node = k.node),
f{n + 1} AS MATERIALIZED (SELECT * FROM (SELECT m.node, row_number() OVER (ORDER BY first, m.node) - 1 AS place, w AS pw FROM m{n} m JOIN k{n} k ON k.node = m.node WHERE m.node NOT IN (SELECT node FROM s{n})) WHERE place < {expansions} - (SELECT count(*) FROM s{n})),
s{n + 1} AS MATERIALIZED (SELECT node FROM s{n} UNION SELECT node FROM f{n + 1})""")  # fmt: skip
    return ",\n".join(parts) + f" SELECT node, round(w, 6) AS weight, lev AS level FROM k{levels}"


@query("gra_related", _related_sql(HUB))
def _(g):
    return traversal.related(g, HUB)


@query("gra_node_edges", f""", t AS (SELECT 'out' AS side, c1 || ' --' || relation || '--> ' || c2 || ' (' || score || ')' AS text FROM useful WHERE c1 = '{HUB}' ORDER BY text LIMIT 1000),
u AS (SELECT 'in' AS side, c1 || ' --' || relation || '--> ' || c2 || ' (' || score || ')' AS text FROM useful WHERE c2 = '{HUB}' ORDER BY text LIMIT 1000) SELECT * FROM t UNION ALL SELECT * FROM u""")
def _(g):
    return traversal.node_edges(g, HUB)


@query("mat_singular_vectors")
def _(g):
    vectors, values = matrix.singular_vectors(matrix.normalised(matrix.build_matrix(matrix.quads(g))), k=3)
    names = F.array(*[F.lit(float(v)) for v in values])
    return vectors.withColumn("singular_values", names)


@query("mat_similar_terms")
def _(g):
    vectors, values = matrix.singular_vectors(matrix.normalised(matrix.build_matrix(matrix.quads(g))), k=3)
    return matrix.similar_terms(matrix.activation(vectors, values), fn.term_list("blue anvil,cold widget@0.5,nowhere"), 20)


@query("mat_similar_terms_150")
def _(g):
    vectors, values = matrix.singular_vectors(matrix.normalised(matrix.build_matrix(matrix.quads(g))), k=150)
    return matrix.similar_terms(matrix.activation(vectors, values), fn.term_list("blue anvil,cold widget@0.5,nowhere"), 20)


_CELLS = """, k AS (SELECT text FROM concepts WHERE num_assertions >= 5), q AS (SELECT c1, relation, c2, value / 10.0 * log2(greatest(score + 1, 1)) AS value FROM useful WHERE c1 IN (SELECT text FROM k) AND c2 IN (SELECT text FROM k)),
f AS (SELECT c1 AS concept, 'right' AS direction, relation, c2 AS other, value FROM q UNION ALL SELECT c2, 'left', relation, c1, value FROM q),
c AS (SELECT concept, direction, relation, other, sum(value) AS value FROM f GROUP BY ALL),
m AS (SELECT * FROM c WHERE concept IN (SELECT concept FROM c GROUP BY concept HAVING count(*) >= 5) AND (direction, relation, other) IN (SELECT direction, relation, other FROM c GROUP BY ALL HAVING count(*) >= 5))"""


@query("mat_top_features", _CELLS + f" SELECT concept, direction, relation, other, round(value, 5) AS value FROM m WHERE concept = '{HUB}' ORDER BY m.value DESC, direction, relation, other LIMIT 10")
def _(g):
    return matrix.top_features(matrix.build_matrix(matrix.quads(g)), HUB).select("concept", "direction", "relation", "other", F.round("value", 5).alias("value"))


_NORMALISED = _CELLS + """, r AS (SELECT concept, sqrt(sum(value * value)) AS r FROM m GROUP BY concept), k2 AS (SELECT direction, relation, other, sqrt(sum(value * value)) AS k FROM m GROUP BY ALL),
z AS (SELECT m.concept, m.direction, m.relation, m.other, value / sqrt(r * k) AS value FROM m JOIN r USING (concept) JOIN k2 USING (direction, relation, other))"""


@query("mat_energy", _NORMALISED + " SELECT concept, round(sum(value * value), 4) + 0.0 AS energy FROM z GROUP BY concept")
def _(g):
    """What the singular values and vectors give back of each row's squares; at this rank, nothing is left out."""
    vectors, values = matrix.singular_vectors(matrix.normalised(matrix.build_matrix(matrix.quads(g))), k=200)
    part = F.zip_with("v", F.array(*[F.lit(float(x)) for x in values]), lambda v, s: v * v * s * s)
    return vectors.select("concept", (F.round(F.aggregate(part, F.lit(0.0), lambda s, x: s + x), 4) + 0.0).alias("energy"))


def _squished_sql(rounds: int = 12) -> str:
    """Rounds of leaving out what is under the cutoff; more than any of the tables needs."""
    parts = [_CELLS.rpartition(",\nm AS")[0] + ", m0 AS MATERIALIZED (SELECT * FROM c)"]
    for i in range(rounds):
        parts.append(
            f"m{i + 1} AS MATERIALIZED (SELECT * FROM m{i} WHERE concept IN (SELECT concept FROM m{i} GROUP BY concept HAVING count(*) >= 5) AND (direction, relation, other) IN (SELECT direction, relation, other FROM m{i} GROUP BY ALL HAVING count(*) >= 5))"
        )
    return ", ".join(parts) + f" SELECT concept, direction, relation, other, round(value, 5) AS value FROM m{rounds}"


@query("mat_squished", _squished_sql())
def _(g):
    return matrix.squished(matrix.summed_cells(matrix.quads(g))).withColumn("value", F.round("value", 5))


@query("mat_near_anchor", """WITH a AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 1)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 5) AS cosine FROM embeddings, a WHERE list_cosine_similarity(embedding::DOUBLE[], q) > 0.2""", graph=False)
def _(g):
    return matrix.near_anchor(g.table("embeddings"), 1, 0.2).withColumn("cosine", F.round("cosine", 5))


@query(
    "mat_blend",
    _NORMALISED
    + """, x AS (SELECT DISTINCT p_name AS concept, 'right' AS direction, 'HasColor' AS relation, split_part(p_name, ' ', 1) AS other, 10.0::DOUBLE AS value FROM part WHERE split_part(p_name, ' ', 1) IN ('blue', 'red', 'green')),
xr AS (SELECT concept, sqrt(sum(value * value)) AS r FROM x GROUP BY concept), xk AS (SELECT direction, relation, other, sqrt(sum(value * value)) AS k FROM x GROUP BY ALL),
y AS (SELECT x.concept, x.direction, x.relation, x.other, value / sqrt(r * k) AS value FROM x JOIN xr USING (concept) JOIN xk USING (direction, relation, other))
SELECT concept, direction, relation, other, round(sum(value) * 0.5, 5) AS value FROM (SELECT * FROM z UNION ALL SELECT * FROM y) GROUP BY concept, direction, relation, other""",
)
def _(g):
    named = g.table("part").select(F.col("p_name").alias("word"), F.split("p_name", " ")[0].alias("colour"), F.lit(10).alias("weight")).distinct()
    contexts = named.where(F.col("colour").isin("blue", "red", "green"))
    return matrix.blend([(matrix.build_matrix(matrix.quads(g)), 0.5), (matrix.colour_cells(contexts), 0.5)]).withColumn("value", F.round("value", 5))
