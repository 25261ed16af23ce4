"""Coloured text: words by the colours that their vectors lean to, put back in their order.

A text is cut into lines and words with their places. The OFTEN words with most places meet their vectors where
they stand, by a broadcast; the others, which then have few places each, in one equi join. Lines and texts are put
together again by place. A line's own colour is that of the sum of its
words' vectors. Groups are single lines and texts, so they are bounded by a row of the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.operators import matrix, spectral
from meshwright.sources.store import written

#: The colours and their red, green and blue.
RGB = {
    "blue": (0, 0, 255), "black": (0, 0, 0), "brown": (139, 69, 19), "green": (0, 255, 0), "grey": (100, 100, 100), "orange": (255, 165, 0),
    "pink": (255, 105, 180), "purple": (160, 32, 240), "red": (255, 0, 0), "white": (255, 255, 255), "yellow": (255, 255, 0),
}
GREY = (128, 128, 128)
OFTEN = 50_000

Vectors = list[tuple[str, list[float]]]


def _added(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _product(v: Column, other: list[float]) -> Column:
    return F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in other]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` worked out once however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def similarities(v: Column, size: Column, colours: Vectors) -> list[Column]:
    """The cosine with each colour of a vector of length `size`; 0 for a vector of zeros."""
    out = []
    for _, c in colours:
        own = sum(x * x for x in c) ** 0.5
        out.append(F.when(size > 0, _product(v, c) / (size * F.lit(own))).otherwise(0.0) if own else F.lit(0.0))
    return out


def mixed(v: Column, colours: Vectors, rgb: dict[str, tuple[int, int, int]] = RGB) -> Column:
    """r, g, b of a vector: colours weighed by the cubes of their similarities, cut to 0 to 255 at each step; grey without a vector."""
    cubes = _let(_length(v), lambda size: F.transform(F.array(*similarities(v, size, colours)), lambda s: s * s * s))
    grey = F.struct(*[F.lit(g).alias(n) for g, n in zip(GREY, "rgb")])
    if not colours:
        return F.when(v.isNull(), grey).otherwise(F.struct(*[F.lit(0).alias(n) for n in "rgb"]))

    def channel(i: int, shares: Column) -> Column:
        out = F.lit(0)
        for j, (name, _) in enumerate(colours):
            out = F.greatest(F.lit(0), F.least(F.lit(255), (shares[j] * float(rgb[name][i]) + out).cast("int")))
        return out

    def shares(parts: Column) -> Column:
        total = _added([parts[j] for j in range(len(colours))])
        return _let(total, lambda t: F.transform(parts, lambda x: F.when(t == 0, F.lit(0.0)).otherwise(x / t)))

    mix = _let(_let(cubes, shares), lambda c: F.struct(*[channel(i, c).alias(n) for i, n in enumerate("rgb")]))
    return F.when(v.isNull(), grey).otherwise(mix)


def strength(v: Column, colours: Vectors) -> Column:
    """How much a vector's direction lies along all colours together."""
    total = [sum(x) for x in zip(*(c for _, c in colours))]
    return _let(_length(v), lambda size: F.when(size > 0, _product(v, total) / size).otherwise(0.0))


def learned(cells: DataFrame, contexts: DataFrame, k: int = 100, share: float = 0.1, tol: float = 1e-4) -> tuple[DataFrame, Vectors]:
    """concept and v from the blend of a graph's cells with colour contexts (word, colour), and the colours' vectors.

    A context word has its colour and is colourful; a colour has itself, five times as strongly. A colour's vector
    is a share of its word's and that of the feature of having it.
    """
    feature = lambda relation, other, weight: F.struct(F.lit("right").alias("direction"), F.lit(relation).alias("relation"), other.alias("other"), F.lit(weight).alias("value"))
    colour = F.col("colour")
    said = contexts.select(F.col("word").alias("concept"), F.explode(F.array(feature("HasColor", colour, 10.0), feature("HasProperty", F.lit("colorful"), 10.0), feature("HasProperty", colour, 10.0))).alias("f"))
    own = contexts.select("colour").distinct().select(colour.alias("concept"), F.explode(F.array(feature("HasColor", colour, 50.0), feature("HasProperty", colour, 50.0))).alias("f"))
    contexts_cells = said.unionByName(own).select("concept", "f.*").groupBy("concept", "direction", "relation", "other").agg(F.sum("value").alias("value"))
    blend = matrix.blend([(contexts_cells, 0.5), (cells, 0.5)])
    name = F.concat_ws("|", "direction", "relation", "other")
    found = spectral.decompose(blend.select("concept", name.alias("feature"), "value"), "concept", "feature", k, tol)
    grown = F.zip_with("v", F.array(*[F.lit(float(s)) for s in found.values]), lambda a, b: a * b)
    vectors = found.vectors.select("concept", grown.alias("v"))
    rows = {r.concept: r.v for r in vectors.where(F.col("concept").isin(list(RGB))).collect()}  # at most as many as there are colours
    columns = {r.feature: r.v for r in found.columns.where(F.col("feature").isin([f"right|HasColor|{c}" for c in RGB])).select("feature", grown.alias("v")).collect()}
    zero = [0.0] * len(found.values)
    both = [(c, [share * a + b for a, b in zip(rows.get(c, zero), columns.get(f"right|HasColor|{c}", zero))]) for c in RGB if c in rows]
    return vectors, both


def coloured_concepts(vectors: DataFrame, colours: Vectors) -> DataFrame:
    """concept, its colour and how colourful it is."""
    return vectors.select("concept", mixed(F.col("v"), colours).alias("c"), strength(F.col("v"), colours).alias("strength")).select("concept", "c.r", "c.g", "c.b", "strength")


def coloured_texts(texts: DataFrame, vectors: DataFrame, colours: Vectors, key: str = "doc_id", least: float = 1.0, rgb: dict[str, tuple[int, int, int]] = RGB) -> DataFrame:
    """key and html: a text's lines as blocks on the colour of their words together, and words of `least` strength or more on their own.

    `texts` has the key, unique, and `text`; `vectors` has concept and v. Words are looked up in lower case.
    A null text has no html.
    """
    put = lambda before, c, after: F.concat(F.lit(before), c, F.lit(after))
    said = lambda c: F.concat_ws(",", c.r, c.g, c.b)
    line = texts.select(F.col(key).alias("key"), F.posexplode(F.split("text", "\n")).alias("line", "words"))
    word = line.select("key", "line", F.posexplode(F.split("words", " ")).alias("at", "word")).withColumn("concept", F.lower("word"))
    strong = F.abs(strength(F.col("v"), colours)) >= least
    known = written(vectors.select("concept", "v", F.when(strong, said(mixed(F.col("v"), colours, rgb))).alias("own")), "colours")
    often = word.groupBy("concept").count().orderBy(F.desc("count"), "concept").limit(OFTEN).select("concept")
    often = F.broadcast(written(often.join(known, "concept", "left"), "often"))
    # a word that isn't among the OFTEN has at most one in OFTEN of all places
    met = word.join(often, "concept").unionByName(word.join(often, "concept", "left_anti").join(known, "concept", "left"))
    dim = len(colours[0][1]) if colours else 0
    summed = [F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(dim)]
    lines = met.groupBy("key", "line").agg(F.sort_array(F.collect_list(F.struct("at", "word", "own"))).alias("w"), F.count("v").alias("n"), *summed)
    together = F.when(F.col("n") > 0, F.array(*[F.col(f"v{i}") for i in range(dim)]).cast("array<double>"))
    shown = F.transform("w", lambda x: F.coalesce(F.concat(put('<span style="background-color: rgb(', x.own, ')">'), x.word, F.lit("</span>")), x.word))
    lines = lines.select("key", "line", F.array_join(shown, " ").alias("words"), together.alias("v"))
    lines = lines.select("key", "line", "words", said(mixed(F.col("v"), colours, rgb)).alias("c"))
    block = F.concat(put('<div style="background-color: rgb(', F.col("c"), '); padding: 1ex;">'), F.col("words"), F.lit("</div>"))
    whole = lines.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("line", block.alias("html")))).alias("l"))
    return whole.select(F.col("key").alias(key), F.array_join(F.transform("l", lambda x: x.html), "\n").alias("html"))
