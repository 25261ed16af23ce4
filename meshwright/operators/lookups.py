"""Look-ups and feature queries over a Graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions import scalars as fn
from meshwright.sources.graph import FREQUENCIES, Graph

_FREQUENCIES = dict(FREQUENCIES)


def _top(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy(F.desc("score"), "relation", "c1", "c2", "freq").limit(limit)


def concept_assertions(g: Graph, text: str, limit: int | None = None, direction: str = "all") -> DataFrame:
    """Useful assertions that touch a concept, best first; a direction is filtered after the limit."""
    top = _top(g.touching(text), fn.clamp_limit(limit))
    if direction != "all":
        top = top.where(F.col("c1" if direction == "forward" else "c2") == text)
    return top.select("relation", "c1", "c2", "freq", "score", fn.polarity(F.col("value")).alias("polarity"))


def matching_assertions(g: Graph, direction: str, relation: str, concept: str, limit: int | None = None) -> DataFrame:
    """Assertions of positive score with a feature; visibility doesn't matter here."""
    side = "c1" if direction == "left" else "c2"
    table = g.assertions if side == "c1" else g.by_c2
    found = table.where((F.col("score") > 0) & (F.col("relation") == relation) & (F.col(side) == concept))
    return _top(found, fn.clamp_limit(limit, over=20)).select("relation", "c1", "c2", "freq", "score")


def find_assertion(g: Graph, relation: str, c1: str, c2: str) -> DataFrame:
    return g.assertions.where((F.col("relation") == relation) & (F.col("c1") == c1) & (F.col("c2") == c2)).distinct()


def concept_features(g: Graph, text: str) -> DataFrame:
    """Distinct relations at either side of a concept, whatever the score."""
    side = lambda c, name: (g.assertions if c == "c1" else g.by_c2).where(F.col(c) == text).select(F.lit(name).alias("direction"), "relation").distinct()
    return side("c1", "left").unionByName(side("c2", "right"))


def feature_scores(g: Graph) -> DataFrame:
    """The best score of each concept and feature over all frequencies, and whether it holds."""
    a = g.assertions
    both = F.array(
        F.struct(F.col("c1").alias("concept"), F.lit("right").alias("direction"), F.col("c2").alias("other")),
        F.struct(F.col("c2").alias("concept"), F.lit("left").alias("direction"), F.col("c1").alias("other")),
    )
    rows = a.select("relation", "score", F.explode(both).alias("f")).select("f.concept", "f.direction", "relation", "f.other", "score")
    best = rows.groupBy("concept", "direction", "relation", "other").agg(F.max("score").alias("best"))
    return best.withColumn("holds", F.col("best") > 0)


def top_by_feature(g: Graph, text: str, limit: int = 50) -> DataFrame:
    """For each relation and direction, a concept's best assertions of positive score, with the group's size."""
    here = g.touching(text, useful=False).where("score > 0")
    here = here.withColumn("direction", F.when(F.col("c1") == text, "forward").otherwise("reverse"))
    group = Window.partitionBy("direction", "relation")
    ranked = here.withColumns({"rank": F.row_number().over(group.orderBy(F.desc("score"), "c1", "c2", "freq")), "size": F.count(F.lit(1)).over(group)}).where(F.col("rank") <= limit)
    return ranked.select("direction", "relation", "rank", "c1", "c2", "freq", (F.col("value") > 0).alias("positive"), "size")


def surface_forms(g: Graph, text: str, limit: int | None = None) -> DataFrame:
    found = g.surfaces.where(F.col("concept") == text).orderBy(F.desc("use_count"), "surface")
    return found.limit(fn.clamp_limit(limit))


def resolve(g: Graph, texts: DataFrame) -> DataFrame:
    """text and concept: an exact surface form first, else the concept of that text; null if neither."""
    best = Window.partitionBy("surface").orderBy(F.desc("use_count"), "concept")
    by_surface = g.surfaces.withColumn("rn", F.row_number().over(best)).where("rn = 1").select(F.col("surface").alias("text"), F.col("concept").alias("s"))
    by_text = g.concepts.select("text", F.col("text").alias("c"))
    return texts.join(by_surface, "text", "left").join(by_text, "text", "left").select("text", F.coalesce("s", "c").alias("concept"))


def best_surface(g: Graph) -> DataFrame:
    """Each concept's most used surface form: its canonical name."""
    top = F.max_by("surface", F.struct("use_count", "surface"))
    return g.surfaces.groupBy("concept").agg(top.alias("canonical_name"))


def best_raw(g: Graph) -> DataFrame:
    """Each assertion's best raw assertion, by score and then frame."""
    best = Window.partitionBy("relation", "c1", "c2", "freq").orderBy(F.desc("score"), "frame_id")
    return g.raws.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def render(g: Graph) -> DataFrame:
    """Each assertion in words, by its best raw assertion."""
    text = fn.fill_in(F.col("frame"), F.trim("c1"), F.trim("c2"))
    return best_raw(g).select("relation", "c1", "c2", "freq", "frame_id", text.alias("sentence"))


def feature_frames(g: Graph) -> DataFrame:
    """The frame that best words each relation: a good one (3 or more) of positive frequency, else a fair one, else any."""
    values = F.create_map(*[F.lit(x) for pair in _FREQUENCIES.items() for x in pair])
    tier = F.when((values[F.col("freq")] > 0) & (F.col("goodness") >= 3), 0).when((values[F.col("freq")] > 0) & (F.col("goodness") >= 2), 1).otherwise(2)
    best = Window.partitionBy("relation").orderBy("tier", F.desc("goodness"), "frame_id")
    ranked = g.frames.withColumn("tier", tier).withColumn("rn", F.row_number().over(best))
    return ranked.where("rn = 1").select("relation", "frame_id", "tier", fn.fill_in(F.col("text"), F.lit("..."), F.lit("...")).alias("display"))


def questions(g: Graph) -> DataFrame:
    """A yes/no question for each useful assertion: the frame's own, or its statement with a question mark."""
    best = best_raw(g).join(F.broadcast(g.frames.select("frame_id", "question_yn")), "frame_id")
    wrap = lambda c: F.concat(F.lit("[["), F.col(c), F.lit("]]"))
    asked = F.coalesce("question_yn", F.concat("frame", F.lit("?")))
    return best.where("assertion_score > 0").select("relation", "c1", "c2", "freq", fn.fill_in(asked, wrap("c1"), wrap("c2")).alias("question"))


def top_groups(g: Graph, text: str) -> DataFrame:
    """direction, relation and size of the groups of a concept's assertions of positive score, all counted."""
    here = g.touching(text, useful=False).where("score > 0")
    return here.groupBy(F.when(F.col("c1") == text, "forward").otherwise("reverse").alias("direction"), "relation").agg(F.count("*").alias("size"))


def top_surfaces(g: Graph, text: str, limit: int = 50) -> DataFrame:
    """As `top_by_feature`, of the assertions that have a best raw, with the other side's surface and the frequency's text."""
    keys = ["relation", "c1", "c2", "freq"]
    best = best_raw(g).where((F.col("c1") == text) | (F.col("c2") == text)).select(*keys, "surface1", "surface2")
    here = g.touching(text, useful=False).where("score > 0").join(best, keys)
    forward = F.col("c1") == text
    here = here.withColumns({"direction": F.when(forward, "forward").otherwise("reverse"), "surface": F.when(forward, F.col("surface2")).otherwise(F.col("surface1"))})
    group = Window.partitionBy("direction", "relation")
    ranked = here.withColumns({"rank": F.row_number().over(group.orderBy(F.desc("score"), "c1", "c2", "freq")), "size": F.count(F.lit(1)).over(group)})
    return ranked.where(F.col("rank") <= limit).select("direction", "relation", "rank", "surface", "freq", (F.col("value") > 0).alias("positive"), "score", "size")
