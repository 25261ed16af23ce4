"""Quads, sparse cells and similarity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import scalars as fn
from meshwright.operators import spectral
from meshwright.sources import store
from meshwright.sources.graph import Graph


def quads(g: Graph, cutoff: int = 5) -> DataFrame:
    """c1, relation, c2, value of useful assertions whose concepts both have `cutoff` assertions."""
    known = g.concepts.where(F.col("num_assertions") >= cutoff).select("text")
    kept = g.useful.join(known.withColumnRenamed("text", "c1"), "c1", "left_semi").join(known.withColumnRenamed("text", "c2"), "c2", "left_semi")
    return kept.select("c1", "relation", "c2", fn.edge_value(F.col("score"), F.col("value")).alias("value"))


def raw_quads(g: Graph) -> DataFrame:
    """Six quads for each raw assertion: as worded, as normalised, and what normalises to what."""
    v = fn.edge_value(F.col("score"), F.col("value"))
    s1, s2 = F.concat(F.lit("the "), "c1"), F.concat(F.lit("the "), "c2")
    one = lambda a, r, b, w: F.struct(a.alias("c1"), r.alias("relation"), b.alias("c2"), w.alias("value"))
    norm, unit = F.lit("NormalizesTo"), F.lit(1.0)
    c1, c2 = F.col("c1"), F.col("c2")
    every = F.array(
        one(s1, F.col("frame_id").cast("string"), s2, v), one(c1, F.col("relation"), c2, v),
        one(c1, norm, s1, unit), one(c2, norm, s2, unit), one(c1, norm, c1, unit), one(c2, norm, c2, unit),
    )
    return g.raws.where("score > 0").select(F.explode(every).alias("q")).select("q.*")


def rating_quads(g: Graph) -> DataFrame:
    """A quad for each vote on an assertion."""
    a = g.assertions.where("relation = 'CapableOf'").select("relation", "c1", "c2", "value")
    return g.votes.join(a, ["c1", "c2"]).select("user_id", "c1", "relation", "c2", (F.col("vote") * F.col("value") / 10).alias("value"))


def to_features(q: DataFrame) -> DataFrame:
    """Two cells a quad: c1 with its right feature, c2 with its left one."""
    cell = lambda row, side, other: F.struct(F.col(row).alias("concept"), F.lit(side).alias("direction"), F.col("relation"), F.col(other).alias("other"), F.col("value"))
    return q.select(F.explode(F.array(cell("c1", "right", "c2"), cell("c2", "left", "c1"))).alias("x")).select("x.*")


def to_concepts(q: DataFrame) -> DataFrame:
    """Two symmetric cells a quad, without the relation."""
    cell = lambda a, b: F.struct(F.col(a).alias("row"), F.col(b).alias("col"), F.col("value"))
    return q.select(F.explode(F.array(cell("c1", "c2"), cell("c2", "c1"))).alias("x")).select("x.*")


def to_pairs(q: DataFrame) -> DataFrame:
    return q.select(F.struct("c1", "c2").alias("pair"), "relation", "value")


def identities(q: DataFrame, weight: float = 1.0) -> DataFrame:
    """(c, InheritsFrom, c) for each left concept at `weight`, and one more for each IsA quad at its value."""
    c1, rel = F.col("c1"), F.lit("InheritsFrom")
    each = q.select("c1").distinct().select("c1", rel.alias("relation"), c1.alias("c2"), F.lit(weight).alias("value"))
    return each.unionByName(q.where("relation = 'IsA'").select("c1", rel.alias("relation"), c1.alias("c2"), "value"))


def build_matrix(q: DataFrame, cutoff: int = 5) -> DataFrame:
    """Summed feature cells of the rows and columns that have at least `cutoff` cells."""
    col = ["direction", "relation", "other"]
    cells = store.written(summed_cells(q), "cells")
    rows = cells.groupBy("concept").agg(F.count("*").alias("n")).where(F.col("n") >= cutoff)
    cols = cells.groupBy(*col).agg(F.count("*").alias("n")).where(F.col("n") >= cutoff)
    return cells.join(rows, "concept", "left_semi").join(cols, col, "left_semi")


def squished(cells: DataFrame, cutoff: int = 5) -> DataFrame:
    """The largest part of the cells whose rows and columns all have `cutoff` cells.

    Rows and columns under the cutoff go, which may take others under it, until none is left to go.
    Each round's cells are written once; a round that removes nothing ends the loop.
    """
    col = ["direction", "relation", "other"]
    scratch = store.Scratch(cells.sparkSession)
    now = scratch.written(cells, "cells")
    n = now.count()
    while True:
        many = lambda keys: now.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= cutoff)  # noqa: E731, B023
        after = scratch.written(now.join(many(["concept"]), "concept", "left_semi").join(many(col), col, "left_semi").select(*cells.columns), "cells")
        left = after.count()
        scratch.drop([now])
        now = after
        if left == n:
            return now
        n = left


def summed_cells(q: DataFrame) -> DataFrame:
    """The feature cells of quads, equal ones summed: quads are summed first, as both cells of a quad equal only those of its like."""
    return to_features(q.groupBy("c1", "relation", "c2").agg(F.sum("value").alias("value")))


def normalised(cells: DataFrame) -> DataFrame:
    """Cells over the roots of their row's and column's lengths."""
    col = ["direction", "relation", "other"]
    square = F.sqrt(F.sum(F.col("value") ** 2))
    cells = store.written(cells, "cells")  # read three times
    r = cells.groupBy("concept").agg(square.alias("r"))
    c = cells.groupBy(*col).agg(square.alias("c"))
    return cells.join(r, "concept").join(c, col).select("concept", *col, (F.col("value") / F.sqrt(F.col("r") * F.col("c"))).alias("value"))


def singular_vectors(cells: DataFrame, k: int = 2, rounds: int = 40, seed: int = 3, tol: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """concept and v, its entries of the k leading left singular vectors, and the singular values."""
    features = cells.select("concept", F.concat_ws("|", "direction", "relation", "other").alias("feature"), "value")
    found = spectral.decompose(features, "concept", "feature", k, tol, rounds, seed)
    return found.vectors, found.values


def activation(vectors: DataFrame, values: list[float], offset: float = 1e-5) -> DataFrame:
    """Rows of U * exp(S), each over its length plus an offset: the embedding that similarity uses."""
    grown = F.zip_with("v", F.array(*[F.lit(float(np.exp(x))) for x in values]), lambda a, b: a * b)
    rows = vectors.select("concept", grown.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)) + offset
    return rows.select("concept", length.alias("length"), "v").select("concept", F.transform("v", lambda x: x / F.col("length")).alias("v"))


def similar_terms(vectors: DataFrame, terms: dict[str, float], limit: int = 20) -> DataFrame:
    """Concepts by their product with the weighted sum of the terms' rows, above 0; unknown terms are left out."""
    found = {r.concept: list(r.v) for r in vectors.where(F.col("concept").isin(list(terms))).collect()}
    known = [np.array(v) * terms[c] for c, v in found.items()]
    if not known:
        return vectors.select("concept", F.lit(0.0).alias("score")).where(F.lit(False))
    q = F.array(*[F.lit(float(x)) for x in np.sum(known, 0)])
    score = F.aggregate(F.zip_with("v", q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return vectors.select("concept", score.alias("score")).orderBy(F.desc("score"), "concept").limit(limit).where("score > 0")


def top_features(cells: DataFrame, concept: str, limit: int = 10) -> DataFrame:
    """The strongest cells of a row."""
    return cells.where(F.col("concept") == concept).orderBy(F.desc("value"), "direction", "relation", "other").limit(limit)


def near_anchor(rows: DataFrame, anchor: int, least: float = 0.9) -> DataFrame:
    """Rows of vectors (vec_id, embedding) whose cosine with the anchor's is above `least`."""
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    one = rows.where(F.col("vec_id") == anchor).select(F.col("v").alias("q")).limit(1)
    cosine = dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q"))
    return rows.join(F.broadcast(one), F.lit(True)).select("vec_id", cosine.alias("cosine")).where(F.col("cosine") > least)


def blend(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Cells of several matrices in one: each normalised, at its weight, equal cells summed."""
    col = ["concept", "direction", "relation", "other"]
    rows = [normalised(cells).select(*col, (F.col("value") * w).alias("value")) for cells, w in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy(*col).agg(F.sum("value").alias("value"))


def colour_cells(contexts: DataFrame) -> DataFrame:
    """Cells of (word, colour, weight) rows: each word's feature of having a colour."""
    return contexts.select(F.col("word").alias("concept"), F.lit("right").alias("direction"), F.lit("HasColor").alias("relation"), F.col("colour").alias("other"), F.col("weight").cast("double").alias("value"))


def category(vectors: DataFrame, terms: dict[str, float]) -> list[float] | None:
    """The mean direction of some concepts, as a query vector."""
    found = {r.concept: np.array(r.v) for r in vectors.where(F.col("concept").isin(list(terms))).collect()}
    return None if not found else np.sum([v * terms[c] for c, v in found.items()], 0).tolist()


def similar(vectors: DataFrame, terms: dict[int, float], limit: int = 20) -> DataFrame:
    """The rows whose vectors have the largest positive product with the weighted sum of the terms' vectors."""
    v = F.col("v")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    weight = F.create_map(*[F.lit(x) for pair in terms.items() for x in pair])
    some = rows.where(F.col("vec_id").isin(list(terms))).select(F.posexplode("v").alias("i", "x"), weight[F.col("vec_id")].alias("w"))
    q = some.groupBy("i").agg(F.sum(F.col("x") * F.col("w")).alias("x")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("q")).first()
    query = F.array(*[F.lit(float(r.x)) for r in (q.q if q and q.q else [])])
    score = F.aggregate(F.zip_with(v, query, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", F.round(score, 5).alias("score")).orderBy(F.desc("score"), "vec_id").limit(limit).where("score > 0")
