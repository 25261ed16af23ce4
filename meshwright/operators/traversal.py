"""Graph operators: network, spreading activation, related concepts, analogy."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions import scalars as fn
from meshwright.sources import store
from meshwright.sources.graph import Graph

#: Forward weights of relations in spreading activation; others are not followed.
WEIGHTS = {
    "AtLocation": 0.9, "CapableOf": 0.8, "Causes": 1.0, "CausesDesire": 1.0, "ConceptuallyRelatedTo": 1.0, "CreatedBy": 1.0, "DefinedAs": 1.0,
    "Desires": 1.0, "HasFirstSubevent": 1.0, "HasLastSubevent": 1.0, "HasPrerequisite": 1.0, "HasProperty": 1.0, "HasSubevent": 0.9, "IsA": 0.9,
    "MadeOf": 0.7, "MotivatedByGoal": 1.0, "PartOf": 1.0, "ReceivesAction": 0.6, "UsedFor": 1.0,
}
#: Weights of relations in analogies, 1 for the rest; and relations that don't count there.
ANALOGY = {"HasProperty": 3.0, "UsedFor": 2.0, "CapableOf": 2.0, "ReceivesAction": 1.5}
STOPPED = ["ConceptuallyRelatedTo", "ThematicKLine", "SuperThematicKline"]


def network(g: Graph) -> DataFrame:
    """Useful edges between different, non-empty concepts; parallel edges stay."""
    return g.useful.where("c1 <> '' and c2 <> '' and c1 <> c2").select("c1", "c2", F.col("relation").alias("rel"), "score", "freq")


def _weight(weights: dict[str, float], default: float = 0.0) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(F.col("relation") == name, w).otherwise(out)
    return out


def probabilistic_or(score: Column) -> Column:
    """a + b - ab over a group, in any order."""
    certain = F.max(F.when(score >= 1, 1.0).otherwise(0.0))
    return F.when(certain == 1.0, 1.0).otherwise(1 - F.exp(F.sum(F.when(score < 1, F.log(1 - score)))))


def spread(g: Graph, origins: dict[str, float], hops: int = 2, beam: int = 500, limit: int = 200, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Activation that reaches concepts within `hops` steps, merged by probabilistic or.

    Each step joins the frontier to the edges and keeps its `beam` strongest visits;
    an edge passes half of the activation, its relation's weight of it, discounted by
    the target's out-degree. Origins aren't results.
    """
    edges = g.useful.select("relation", "c1", "c2").distinct()
    degree = edges.groupBy(F.col("c1").alias("c2")).agg(F.count("*").alias("d"))
    factor = F.lit(0.5) * fn.branching_discount(F.coalesce("d", F.lit(0)).cast("double")) * _weight(weights)
    step = edges.join(degree, "c2", "left").withColumn("factor", factor).where("factor > 0").select("c1", "c2", "factor")
    frontier = g.spark.createDataFrame(list(origins.items()), "node string, s double")
    visits = None
    for _ in range(hops):
        # weaker visits, and of equally strong ones those of later names, fall out of the beam
        nexts = frontier.join(step, frontier.node == step.c1).select(F.col("c2").alias("node"), (F.col("s") * F.col("factor")).alias("s"))
        frontier = nexts.orderBy(F.desc("s"), "node").limit(beam)
        visits = frontier if visits is None else visits.unionByName(frontier)
    found = visits.where(~F.col("node").isin(list(origins))).groupBy("node").agg(probabilistic_or(F.col("s")).alias("score"))
    return found.select("node", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "node").limit(limit)


def spread_out(g: Graph, origins: dict[str, float] | list[str] | str, least: float = 1e-5, beam: int = 500, limit: int = 200, weights: tuple[dict, dict] | None = None) -> DataFrame:
    """Activation that spreads, both ways where relations have reverse weights, until no visit has `least` left.

    As every way passes at most half on, that ends. Each step joins the frontier to the ways, keeps its `beam`
    strongest visits and is written, so no step is computed twice and lineage stays short. Visits of a
    concept merge by probabilistic or; origins aren't results.
    """
    start, _ = known_origins(g, origins)
    forward, reverse = weights or link_weights()
    nothing = g.spark.createDataFrame([], "node string, score double")
    if not start or not (any(forward.values()) or any(reverse.values())):
        return nothing
    scratch = store.Scratch(g.spark)
    ways = scratch.written(_directed(g, forward, reverse), "ways")
    frontier, steps = g.spark.createDataFrame(list(start.items()), "node string, s double"), []
    while True:
        nexts = frontier.join(ways, "node").select(F.col("other").alias("node"), (F.col("s") * F.col("factor")).alias("s")).where(F.col("s") >= least)
        frontier = scratch.written(nexts.orderBy(F.desc("s"), "node").limit(beam), "step")
        if frontier.isEmpty():
            break
        steps.append(frontier)
    if not steps:
        return nothing
    visits = steps[0]
    for s in steps[1:]:
        visits = visits.unionByName(s)
    found = visits.where(~F.col("node").isin(list(start))).groupBy("node").agg(probabilistic_or(F.col("s")).alias("score"))
    return found.select("node", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "node").limit(limit)


#: The forward weights of each projection.
PROJECTIONS = {
    "affective": {"Desires": 1.0, "CausesDesire": 1.0, "MotivatedByGoal": 1.0},
    "spatial": {"AtLocation": 1.0, "ConceptuallyRelatedTo": 0.5},
    "details": {"HasFirstSubevent": 1.0, "HasLastSubevent": 1.0, "HasSubevent": 1.0, "MadeOf": 1.0, "PartOf": 1.0, "HasProperty": 0.9},
    "consequences": {"CausesDesire": 1.0, "UsedFor": 0.4, "CapableOf": 0.4, "ReceivesAction": 0.3, "Causes": 1.0},
}


def link_weights(forward: dict[str, float] | None = None, reverse: dict[str, float] | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """Weights by relation for both directions: the defaults, or what is given with 0 for the rest."""
    if forward is None and reverse is None:
        return dict(WEIGHTS), dict.fromkeys(WEIGHTS, 0.0)
    return {r: (forward or {}).get(r, 0.0) for r in WEIGHTS}, {r: (reverse or {}).get(r, 0.0) for r in WEIGHTS}


def origin_weights(origins: dict[str, float] | list[str] | str) -> dict[str, float]:
    """Origins as texts with weights, from a text, a list or a dict; trimmed."""
    given = {origins: 1.0} if isinstance(origins, str) else origins if isinstance(origins, dict) else dict.fromkeys(origins, 1.0)
    return {text.strip(): float(w) for text, w in given.items()}


def known_origins(g: Graph, origins: dict[str, float] | list[str] | str) -> tuple[dict[str, float], list[str]]:
    """The concepts that the origins name, whatever their case, and the names that aren't known."""
    wanted = origin_weights(origins)
    low = {t.lower(): w for t, w in wanted.items()}
    rows = g.concepts.where(F.lower("text").isin(list(low))).groupBy(F.lower("text").alias("low")).agg(F.min("text").alias("text")).collect()
    return {r.text: low[r.low] for r in rows}, sorted(t for t in wanted if t.lower() not in {r.low for r in rows})


def _directed(g: Graph, forward: dict[str, float], reverse: dict[str, float]) -> DataFrame:
    """node, other, factor of every way along an edge whose relation has a weight, discounted by the other end's degree."""
    edges = g.useful.select("relation", "c1", "c2").distinct()
    ways = []
    for here, there, weights in (("c1", "c2", forward), ("c2", "c1", reverse)):
        if any(weights.values()):
            degree = edges.groupBy(F.col(here).alias(there)).agg(F.count("*").alias("d"))
            factor = F.lit(0.5) * fn.branching_discount(F.coalesce("d", F.lit(0)).cast("double")) * _weight(weights)
            ways.append(edges.join(degree, there, "left").select(F.col(here).alias("node"), F.col(there).alias("other"), factor.alias("factor")).where("factor > 0"))
    out = ways[0]
    for w in ways[1:]:
        out = out.unionByName(w)
    return out


def activate(g: Graph, origins: dict[str, float] | list[str] | str, visits: int = 500, limit: int = 200, weights: tuple[dict, dict] | None = None) -> DataFrame:
    """Spreading activation, best first: the strongest waiting node is visited next and passes its activation on.

    At most `visits` - 1 visits; the queue holds the `QUEUE` strongest; ties go by name; visits of a
    node merge by probabilistic or, and origins aren't results. The queue and the
    ways out of waiting nodes (the QUEUE strongest each, as no more can wait) are bounded, so the
    search runs on the driver and asks Spark for the ways out of many nodes at once.
    """
    start, _ = known_origins(g, origins)
    forward, reverse = weights or link_weights()
    if not start or not (any(forward.values()) or any(reverse.values())):
        return g.spark.createDataFrame([], "node string, score double")
    ways = store.written(_directed(g, forward, reverse), "ways")
    top = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("factor"), "other"))
    bounded = ways.withColumn("rn", top).where(F.col("rn") <= QUEUE)
    degrees = {r.c1: r.n for r in g.useful.select("relation", "c1", "c2").distinct().where(F.col("c1").isin(list(start))).groupBy("c1").agg(F.count("*").alias("n")).collect()}
    discount = lambda d: math.exp(-((math.log(d + 5, 5) - 2.5) ** 2) / 2) / math.sqrt(2 * math.pi)
    queue = sorted(((t, w * discount(degrees.get(t, 0))) for t, w in start.items()), key=lambda x: (-x[1], x[0]))
    out: dict[str, list[tuple[str, float]]] = {}
    reached: dict[str, float] = {}
    for _ in range(visits - 1):
        if not queue:
            break
        node, score = queue.pop(0)
        if node not in out:
            # the likeliest next nodes' ways come in the same job
            ask = list(dict.fromkeys([node, *(n for n, _ in queue[:ASK] if n not in out)]))
            out.update({n: [] for n in ask})
            for r in bounded.where(F.col("node").isin(ask)).select("node", "other", "factor").collect():
                out[r.node].append((r.other, r.factor))
        if node not in start:
            reached[node] = 1 - (1 - reached.get(node, 0.0)) * (1 - score)
        queue = sorted(queue + [(other, factor * score) for other, factor in out[node]], key=lambda x: (-x[1], x[0]))[:QUEUE]
    best = sorted(reached.items(), key=lambda x: (-x[1], x[0]))[:limit]
    return g.spark.createDataFrame(best, "node string, score double")


#: Waiting nodes, and nodes asked for in one job.
QUEUE, ASK = 500, 60


def project(g: Graph, kind: str, origins: dict[str, float], **more) -> DataFrame:
    """Activation along the relations of one projection."""
    return spread(g, origins, weights=PROJECTIONS[kind], **more)


def all_projections(g: Graph, origins: dict[str, float], **more) -> DataFrame:
    out = None
    for kind in PROJECTIONS:
        rows = project(g, kind, origins, **more).select(F.lit(kind).alias("projection"), "node", "score")
        out = rows if out is None else out.unionByName(rows)
    return out


def related(g: Graph, root: str, expansions: int = 101, levels: int | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """node, weight, level: what level-by-level expansion from a root reaches, in at most `expansions` expanded nodes.

    A node's weight is its cell's value over the level, times its parent's weight and the relation's.
    A node met again takes the mean of old and new, the new one's part being 1 / (2 (d + 1)) where
    d is how many levels lie between. Within a level parents count by their order, with the weights they
    had when it began, and a parent's edges by relation, name and frequency.

    What is reached is a table that each level writes anew; only the nodes to be expanded next, at most
    `expansions` in all, come to the driver.
    """
    value = fn.edge_value(F.col("score"), F.col("value"))
    edges = g.useful.select(F.col("c1").alias("parent"), "relation", F.col("c2").alias("node"), "freq", value.alias("v"), _weight(weights).alias("w")).where("v > 0 and w > 0")
    scratch = store.Scratch(g.spark)
    known = scratch.written(g.spark.createDataFrame([], "node string, weight double, level int"), "known")
    seen, queue, level = set(), [(root, 1.0)], 0
    while queue and (levels is None or level < levels):
        level += 1
        seen.update(n for n, _ in queue)
        frontier = g.spark.createDataFrame([(n, i, w) for i, (n, w) in enumerate(queue)], "parent string, place int, pw double")
        rows = edges.join(F.broadcast(frontier), "parent")
        # a node has at most a few edges from each of the frontier's bounded number of parents
        part = F.struct("place", "relation", "freq", (F.col("v") / level * F.col("pw") * F.col("w")).alias("x"))
        merged = rows.groupBy("node").agg(F.array_sort(F.collect_list(part)).alias("parts"))
        state = lambda w, at: F.struct(w.alias("weight"), at.cast("int").alias("level"))

        def met(s, p):
            share = 1 / (2 * (F.lit(level) - s.level + 1))
            return F.when(s.level.isNull(), state(p.x, F.lit(level))).otherwise(state(share * p.x + (1 - share) * s.weight, F.lit(level)))

        both = known.join(merged, "node", "full_outer")
        folded = F.aggregate(F.coalesce("parts", F.array().cast(merged.schema["parts"].dataType)), state(F.col("weight"), F.col("level")), met)
        after = scratch.written(both.select("node", folded.alias("s"), F.get("parts", F.lit(0)).alias("first")).select("node", "s.weight", "s.level", "first"), "known")
        fresh = after.where(F.col("first").isNotNull() & ~F.col("node").isin(list(seen))).orderBy("first", "node")
        queue = [(r.node, r.weight) for r in fresh.select("node", "weight", "first").limit(max(0, expansions - len(seen))).collect()]
        known = after.drop("first")
    rounded = known.select("node", F.round("weight", 6).alias("weight"), "level")
    return rounded.orderBy(F.desc("weight"), F.desc("node"))


def node_edges(g: Graph, node: str, limit: int = 1000) -> DataFrame:
    """A node's useful edges, out and in, at most `limit` each, as text."""
    side = lambda table, c, name: g._useful(table.where(F.col(c) == node)).select(F.lit(name).alias("side"), F.format_string("%s --%s--> %s (%d)", "c1", "relation", "c2", "score").alias("text")).orderBy("text").limit(limit)
    return side(g.assertions, "c1", "out").unionByName(side(g.by_c2, "c2", "in"))


def analogous(g: Graph, node: str, limit: int = 50) -> DataFrame:
    """Concepts that share (relation, target) structures with `node`: summed strengths and what is shared.

    A structure whose frequencies and scores sum to less than 1 has strength 0.
    """
    rows = g.useful.where(~F.col("relation").isin(STOPPED)).select("relation", "c1", "c2", "score", "value")
    mine = rows.where(F.col("c1") == node).select("relation", "c2", F.col("score").alias("score1"), F.col("value").alias("value1"))
    others = rows.where(F.col("c1") != node)
    strength = F.log(F.greatest(F.col("value") + F.col("value1") + (F.col("score") + F.col("score1")) * 0.5 + 2, F.lit(1))) / F.log(F.lit(4.0)) * _weight(ANALOGY, 1.0)
    shared = others.join(mine, ["relation", "c2"]).select("c1", strength.alias("s"), F.concat_ws("/", "relation", "c2").alias("structure"))
    found = shared.groupBy(F.col("c1").alias("candidate")).agg(F.round(F.sum("s"), 5).alias("score"), F.array_join(F.array_sort(F.collect_set("structure")), ",").alias("structures"))
    return found.orderBy(F.desc("score"), "candidate").limit(limit)
