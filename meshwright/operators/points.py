"""Point look-ups, raw assertions, features and their wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions import scalars as fn
from meshwright.functions import words
from meshwright.operators import lookups
from meshwright.sources import store
from meshwright.sources.graph import Graph

KEYS = {
    "relation": ("relations", ["name"]),
    "language": ("languages", ["id"]),
    "frequency": ("frequencies", ["text"]),
    "frame": ("frames", ["frame_id"]),
    "concept": ("concepts", ["text"]),
    "surface": ("surfaces", ["surface"]),
    "assertion": ("assertions", ["relation", "c1", "c2", "freq"]),
    "raw": ("raws", ["relation", "c1", "c2", "freq", "frame_id"]),
}
ASSERTION = ["relation", "c1", "c2", "freq"]


class Missing(LookupError):
    """A strict look-up found no row."""


def lookup(g: Graph, kind: str, *key: object, language: str = "en") -> DataFrame:
    """The rows of a kind with this key; none if absent or of another language."""
    table, columns = KEYS[kind]
    rows = getattr(g, table)
    for name, value in zip(columns, key, strict=True):
        rows = rows.where(F.col(name) == F.lit(value))
    return rows.where(F.lit(language == "en"))


def get(g: Graph, kind: str, *key: object) -> dict:
    """The one row of a look-up; `Missing` without it."""
    row = lookup(g, kind, *key).first()
    if row is None:
        raise Missing(f"no {kind} {key}")
    return row.asDict()


def ensure_concept(x: object, language: str = "en") -> tuple[str, str]:
    """A concept reference as (text, language), from a text, a pair or a row."""
    if isinstance(x, str):
        return x, language
    if isinstance(x, tuple):
        return x[0], x[1]
    return x["text"], language


def resolve_normalised(g: Graph, texts: DataFrame) -> DataFrame:
    """text and concept: an exact surface first, else the concept whose normal form equals the text's; null if neither.

    Of several concepts with one normal form the first by text counts.
    """
    exact = lookups.resolve(g, texts)
    form = words.normal_form(F.col("text"))
    forms = g.concepts.select("text", form.alias("form")).where("form <> ''").groupBy("form").agg(F.min("text").alias("by_form"))
    return exact.withColumn("form", form).join(forms, "form", "left").select("text", F.coalesce("concept", "by_form").alias("concept"))


def exists(g: Graph, texts: DataFrame) -> DataFrame:
    """text and whether a concept or a surface form of that text exists."""
    known = g.concepts.select("text").unionByName(g.surfaces.select(F.col("surface").alias("text"))).distinct().withColumn("found", F.lit(True))
    return texts.join(known, "text", "left").select("text", F.coalesce("found", F.lit(False)).alias("found"))


# Raw assertions


def assertion_raws(g: Graph, relation: str, c1: str, c2: str, freq: str) -> DataFrame:
    return lookup_raws(g.raws.where(F.col("c1") == c1)).where((F.col("relation") == relation) & (F.col("c2") == c2) & (F.col("freq") == freq))


def lookup_raws(raws: DataFrame) -> DataFrame:
    """Raw assertions with their accessors: texts, relation, creator, wording."""
    text = fn.fill_in(F.col("frame"), F.trim("surface1"), F.trim("surface2"))
    return raws.select("relation", "c1", "c2", "freq", "frame_id", "goodness", "score", "creator", F.col("surface1").alias("text1"), F.col("surface2").alias("text2"), text.alias("sentence"), "assertion_score")


def concept_raws(g: Graph, text: str) -> DataFrame:
    """Raw assertions of positive score, of assertions of positive score, that touch a concept."""
    here = g.raws.where((F.col("c1") == text) | (F.col("c2") == text)).where("score > 0 and assertion_score > 0")
    return lookup_raws(here)


def concept_raws_no_copies(g: Graph, text: str) -> DataFrame:
    """Those of them that are their assertion's best."""
    best = lookups.best_raw(g).select(*ASSERTION, "frame_id")
    return concept_raws(g, text).join(best, [*ASSERTION, "frame_id"], "left_semi")


def matching_raws(g: Graph, direction: str, relation: str, concept: str) -> DataFrame:
    """Raw assertions with a feature, whatever their score: a left one by the first surface's concept, a right one by the assertion's second concept."""
    if direction == "left":
        owner = g.surfaces.where(F.col("concept") == concept).select(F.col("surface").alias("text1"))
        return lookup_raws(g.raws.where(F.col("relation") == relation)).join(owner, "text1", "left_semi")
    return lookup_raws(g.raws.where((F.col("relation") == relation) & (F.col("c2") == concept)))


def raws_of_frame(g: Graph, frame_id: int, limit: int | None = None) -> DataFrame:
    rows = lookup_raws(g.raws.where(F.col("frame_id") == frame_id))
    return rows.orderBy(F.desc("score"), *ASSERTION).limit(fn.clamp_limit(limit))


def raw_counts(g: Graph) -> DataFrame:
    """Each frame with its number of raw assertions and their creators, frames without any included."""
    n = g.raws.groupBy("frame_id").agg(F.count("*").alias("n_raws"), F.count_distinct("creator").alias("n_creators"))
    return g.frames.select("frame_id", (F.col("goodness") > 2).alias("preferred")).join(n, "frame_id", "left").select("frame_id", "preferred", F.coalesce("n_raws", F.lit(0)).alias("n_raws"), F.coalesce("n_creators", F.lit(0)).alias("n_creators"))


def rated(g: Graph, c1: str) -> DataFrame:
    """The assertions of a left concept with their votes, a row per vote; those without votes have none."""
    votes = g.votes.where(F.col("c1") == c1)
    mark = F.when(F.col("vote") == 1, "Up").when(F.col("vote") == -1, "Down")
    return g.assertions.where(F.col("c1") == c1).join(votes, ["c1", "c2"], "left").select(*ASSERTION, "score", "user_id", "vote", mark.alias("display"))


def votes_of_user(g: Graph, user_id: int | None) -> DataFrame:
    """A user's votes; an anonymous user has none."""
    rows = g.votes.where(F.lit(False)) if user_id is None else g.votes.where(F.col("user_id") == user_id)
    return rows.select("c1", "c2", "vote", (F.col("vote") == 1).alias("is_upvote"), (F.col("vote") == -1).alias("is_downvote"))


def worded_like(g: Graph, text1: str) -> DataFrame:
    """Sentences whose first surface equals a text but for case."""
    return lookup_raws(g.raws.where(F.lower("surface1") == text1.lower())).select("sentence", "creator")


def page(rows: DataFrame, keys: list[str], after: tuple | None, size: int = 100) -> DataFrame:
    """The `size` rows that follow the key `after`, in key order: one top-k for any page."""
    if after is not None:
        rows = rows.where(F.struct(*keys) > F.struct(*(F.lit(v) for v in after)))
    return rows.orderBy(*keys).limit(size)


# Features and propositions


def features_of(g: Graph, text: str, useful_only: bool = True) -> DataFrame:
    """A concept's right features (from its forward assertions) and left ones, with frequency and score."""
    rows = g.touching(text, useful=useful_only)
    right = rows.where(F.col("c1") == text).select(feature("right", "relation", "c2").alias("feature"), "freq", "score")
    left = rows.where(F.col("c2") == text).select(feature("left", "relation", "c1").alias("feature"), "freq", "score")
    return right.unionByName(left)


def feature(direction: str, relation: str, concept: str) -> Column:
    return F.struct(F.lit(direction).alias("direction"), F.col(relation).alias("relation"), F.col(concept).alias("concept"))


def encoded(f: Column) -> Column:
    """A feature as text: `concept\\Relation` for a left one, `Relation/concept` for a right one; null for another side."""
    d, r, c = f["direction"], f["relation"], f["concept"]
    return F.when(d == "left", F.concat(c, F.lit("\\"), r)).when(d == "right", F.concat(r, F.lit("/"), c))


def decoded(text: Column) -> Column:
    """The feature of such a text."""
    left = F.instr(text, "\\") > 0
    cut = F.when(left, F.struct(F.lit("left").alias("direction"), F.element_at(F.split(text, r"\\"), -1).alias("relation"), F.regexp_replace(text, r"\\[^\\]*$", "").alias("concept")))
    return cut.otherwise(F.struct(F.lit("right").alias("direction"), F.substring_index(text, "/", 1).alias("relation"), F.regexp_replace(text, "^[^/]*/", "").alias("concept")))


def filled(f: Column, concept: Column) -> Column:
    """The proposition of a feature and a concept."""
    left = f["direction"] == "left"
    return F.struct(F.when(left, f["concept"]).otherwise(concept).alias("c1"), f["relation"].alias("relation"), F.when(left, concept).otherwise(f["concept"]).alias("c2"))


def feature_uri(f: Column, language: str = "en") -> Column:
    return F.concat(F.lit(f"/api/{language}/"), f["direction"], F.lit("feature/"), f["relation"], F.lit("/"), fn.quoted(f["concept"]), F.lit("/"))


def feature_forms(g: Graph, text: str) -> DataFrame:
    """A concept's features in all their forms: code, address, and the proposition that the concept makes of them."""
    f = features_of(g, text).select("feature").distinct()
    made = filled(F.col("feature"), F.lit(text))
    again = decoded(encoded(F.col("feature")))
    return f.select(encoded(F.col("feature")).alias("code"), feature_uri(F.col("feature")).alias("uri"), made["c1"].alias("c1"), made["relation"].alias("relation"), made["c2"].alias("c2"), (again == F.col("feature")).alias("round_trip"))


def reprs(g: Graph, c1: str) -> DataFrame:
    """Assertions and raw assertions of a left concept as short texts."""
    a = g.assertions.where(F.col("c1") == c1).select(F.lit("assertion").alias("kind"), F.format_string("%s(%s, %s)[%s]", "relation", "c1", "c2", "freq").alias("text"))
    r = g.raws.where(F.col("c1") == c1).select(F.lit("raw").alias("kind"), F.format_string("en: ('%s' %s '%s') s=%d", "surface1", "relation", "surface2", "score").alias("text"))
    return a.unionByName(r)


def grouped_features(g: Graph, text: str) -> DataFrame:
    """A concept's assertions under their features, with the other side's best surface; a row each."""
    names = lookups.best_surface(g)
    rows = g.touching(text, useful=False)
    forward = F.col("c1") == text
    rows = rows.select(F.when(forward, "right").otherwise("left").alias("direction"), "relation", F.when(forward, F.col("c2")).otherwise(F.col("c1")).alias("concept"), "freq", "score")
    return rows.join(names, "concept").select("direction", "relation", "concept", F.col("canonical_name").alias("surface"), "freq", "score")


def feature_parts(g: Graph, direction: str, relation: str, concept: str, gap: str = "___") -> DataFrame:
    """How a feature is worded: frame, the two texts with a gap at the open side, and the statement.

    The frame is that of the feature's best raw assertion with a positive frequency and a
    goodness of 3, else of 2, else the relation's best frame; the text is that raw's
    surface, else the concept's best surface, else the concept.
    """
    values = g.frequencies.where("value > 0").select(F.col("text").alias("freq"))
    held = F.col("c1" if direction == "left" else "c2") == concept
    fits = g.raws.where((F.col("relation") == relation) & held & (F.col("goodness") >= 2)).join(F.broadcast(values), "freq", "left_semi")
    tier = F.when(F.col("goodness") >= 3, 0).otherwise(1)
    own = "surface1" if direction == "left" else "surface2"
    mine = fits.select(tier.alias("tier"), "score", "frame_id", "frame", F.col(own).alias("text")).orderBy("tier", F.desc("score"), "frame_id", "text").limit(1)
    best = lookups.feature_frames(g).where(F.col("relation") == relation).select(F.lit(2).alias("tier"), F.lit(0).cast("long").alias("score"), "frame_id", F.lit(None).cast("string").alias("text"))
    best = best.join(F.broadcast(g.frames.select("frame_id", F.col("text").alias("frame"))), "frame_id").select("tier", "score", "frame_id", "frame", "text")
    chosen = mine.unionByName(best).orderBy("tier").limit(1)
    name = lookups.best_surface(g).where(F.col("concept") == concept).select("canonical_name")
    joined = chosen.join(name, F.lit(True), "left").withColumn("text", F.coalesce("text", "canonical_name", F.lit(concept)))
    text1 = F.col("text") if direction == "left" else F.lit(gap)
    text2 = F.lit(gap) if direction == "left" else F.col("text")
    return joined.select("frame_id", "tier", text1.alias("text1"), text2.alias("text2"), fn.fill_in(F.col("frame"), text1, text2).alias("statement"))


def worded_raws(g: Graph, wrap=lambda c: c) -> DataFrame:
    """Every raw assertion in words; `wrap` is a Column function that marks up the two surfaces."""
    return g.raws.select(*ASSERTION, "frame_id", fn.fill_in(F.col("frame"), wrap(F.trim("surface1")), wrap(F.trim("surface2"))).alias("sentence"))


def proposition_parts(g: Graph) -> DataFrame:
    """Each (c1, relation, c2) in words: by its best raw in a frame of goodness 3 or more, else its best raw of any."""
    best = Window.partitionBy("c1", "relation", "c2").orderBy(F.when(F.col("goodness") >= 3, 0).otherwise(1), F.desc("score"), "freq", "frame_id")
    top = g.raws.withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return top.select("c1", "relation", "c2", "frame_id", F.col("surface1").alias("text1"), F.col("surface2").alias("text2"), fn.fill_in(F.col("frame"), F.col("surface1"), F.col("surface2")).alias("statement"))


def propositions(g: Graph) -> DataFrame:
    """Each proposition that the useful assertions make, and the same with its sides changed, which mostly nobody said."""
    said = g.useful.select("c1", "relation", "c2")
    return said.unionByName(said.select(F.col("c2").alias("c1"), "relation", F.col("c1").alias("c2"))).distinct()


def proposition_wording(g: Graph, rows: DataFrame, least: int = 3) -> DataFrame:
    """Propositions (c1, relation, c2) with the frame and the two texts that word them, and the frame's question.

    The frame is the relation's best of goodness `least` or more, else its best of any. A side's text is the surface
    of the best raw assertion of the relation with that concept there, whatever it says of the other side, else
    the concept's most used surface, else the concept itself. Relations without a frame word nothing.
    """
    best = F.min_by(F.struct("frame_id", "text", "question_yn"), F.struct((F.col("goodness") < least).cast("int"), F.negate("goodness"), "frame_id"))
    frames = g.frames.groupBy("relation").agg(best.alias("f")).select("relation", "f.*")
    names = lookups.best_surface(g)

    def side(i: int) -> DataFrame:
        first = F.min_by(f"surface{i}", F.struct(F.negate("score"), "frame_id", f"surface{i}"))
        return g.raws.groupBy("relation", f"c{i}").agg(first.alias(f"said{i}"))

    out = rows.join(F.broadcast(frames), "relation")
    for i in (1, 2):
        named = names.select(F.col("concept").alias(f"c{i}"), F.col("canonical_name").alias(f"name{i}"))
        out = out.join(side(i), ["relation", f"c{i}"], "left").join(named, f"c{i}", "left").withColumn(f"text{i}", F.coalesce(f"said{i}", f"name{i}", f"c{i}"))
    return out.select("c1", "relation", "c2", "frame_id", F.col("text").alias("frame"), "text1", "text2", "question_yn")


def proposition_questions(g: Graph, rows: DataFrame) -> DataFrame:
    """Propositions asked: the frame's question, or its statement with a question mark, the texts in brackets."""
    mark = lambda c: F.concat(F.lit("[["), F.col(c), F.lit("]]"))
    asked = F.coalesce("question_yn", F.concat("frame", F.lit("?")))
    return proposition_wording(g, rows).select("c1", "relation", "c2", fn.fill_in(asked, mark("text1"), mark("text2")).alias("question"))


def rated_objects(g: Graph, label: str = "Up,Down") -> DataFrame:
    """Every vote of every kind with the object it is on: kind, object, user_id, vote, its label and the object's words and score.

    A vote on (c1, c2) is one on each assertion of the pair, and on the best raw assertion of each; only what exists is rated.
    """
    assertions = g.assertions.where("relation = 'CapableOf'").select(*ASSERTION, "score")
    raws = lookups.best_raw(g).where("relation = 'CapableOf'").select(*ASSERTION, "frame_id", "frame", "surface1", "surface2", "score")
    key = F.concat_ws("|", *ASSERTION)
    a = assertions.select("c1", "c2", F.lit("assertion").alias("kind"), key.alias("object"), F.format_string("%s(%s, %s)[%s]", "relation", "c1", "c2", "freq").alias("words"), "score")
    r = raws.select("c1", "c2", F.lit("raw_assertion").alias("kind"), F.concat_ws("|", key, F.col("frame_id").cast("string")).alias("object"), fn.fill_in(F.col("frame"), F.trim("surface1"), F.trim("surface2")).alias("words"), "score")
    return g.votes.join(a.unionByName(r), ["c1", "c2"]).select("kind", "object", "user_id", "vote", vote_label(F.col("vote"), label).alias("label"), "words", "score")


def vote_label(vote: Column, label: str = "Up,Down") -> Column:
    """A vote by the name of its direction; with other than two names, as its number."""
    names = label.split(",")
    return vote.cast("string") if len(names) != 2 else F.when(vote == 1, names[0]).otherwise(names[1])


def confirm_message(description: Column, direction: Column) -> Column:
    """What asks a user to confirm a vote; the description's signs of markup are written out."""
    safe = description
    for sign, word in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        safe = F.replace(safe, F.lit(sign), F.lit(word))
    clear = F.concat(F.lit("Confirm clearing your vote for <strong>"), safe, F.lit("</strong>."))
    return F.when(direction == "clear", clear).otherwise(F.concat(F.lit("Confirm <strong>"), direction, F.lit("</strong> vote for <strong>"), safe, F.lit("</strong>.")))


def vocabulary(g: Graph, dictionary: DataFrame, stop: tuple[str, ...] = ("a", "the")) -> DataFrame:
    """Concepts with useful assertions whose every word is itself such a concept, and whose name's every word is a function word or in the dictionary (`word`)."""
    kept = g.concepts.where("num_assertions > 0").select("text")
    named = kept.join(lookups.best_surface(g).select(F.col("concept").alias("text"), F.col("canonical_name").alias("name")), "text")
    own = kept.select("text", F.explode(F.split("text", " ")).alias("word")).join(kept.select(F.col("text").alias("word")), "word", "left_anti")
    shown = named.select("text", F.explode(F.split(F.lower("name"), " ")).alias("word")).where(~F.col("word").isin(*stop)).join(dictionary.select("word").distinct(), "word", "left_anti")
    return named.join(own.select("text").unionByName(shown.select("text")).distinct(), "text", "left_anti")


def relation_ends(g: Graph) -> DataFrame:
    """The assertion with the least and the greatest key of each relation."""
    key = F.struct("c1", "c2", "freq")
    return g.assertions.groupBy("relation").agg(F.min(key).alias("a"), F.max(key).alias("z")).select("relation", F.col("a.c1").alias("first_c1"), F.col("a.c2").alias("first_c2"), F.col("z.c1").alias("last_c1"), F.col("z.c2").alias("last_c2"))


def sample(g: Graph, relation: str, n: int, seed: int = 1) -> DataFrame:
    """`n` random assertions of positive score of a relation; the same for the same seed, whatever the partitioning."""
    rows = g.assertions.where((F.col("relation") == relation) & (F.col("score") > 0))
    return rows.select(*ASSERTION, "score").orderBy(F.md5(F.concat_ws("|", *ASSERTION, F.lit(str(seed)))), *ASSERTION).limit(n)


def adjacency(g: Graph, size: int = 1000) -> DataFrame:
    """Neighbour lists of useful edges in both directions, in chunks of `size`, so that a hub is several bounded rows.

    Edges are dealt by range, so a hub's lie in many partitions; an edge's place in its node's list is its place
    within the partition and what the partitions before hold of that node. No task sees a whole hub.
    """
    ends = F.array(F.struct(F.col("c1").alias("node"), F.lit("fwd").alias("direction"), F.col("c2").alias("other")), F.struct(F.col("c2").alias("node"), F.lit("rev").alias("direction"), F.col("c1").alias("other")))
    rows = g.useful.select("relation", F.explode(ends).alias("e")).select("e.*", "relation")
    dealt = rows.repartitionByRange("node", "direction", "relation", "other").withColumn("part", F.spark_partition_id())
    dealt = store.written(dealt, "adjacency")
    held = dealt.groupBy("node", "direction", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("node", "direction").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("node", "direction", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("node", "direction", "part").orderBy("relation", "other")) - 1
    placed = dealt.withColumn("inside", inside).join(before, ["node", "direction", "part"])
    placed = placed.withColumn("chunk", F.floor((F.col("before") + F.col("inside")) / size).cast("int"))
    return placed.groupBy("node", "direction", "chunk").agg(F.array_sort(F.collect_list(F.concat_ws("/", "relation", "other"))).alias("edges"))
