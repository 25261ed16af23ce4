"""Writes as table rewrites: statements, votes, merges, moves and the counts that follow from them.

A knowledge base is four tables: votes (object, user, vote, in order `at`), raws, surfaces and
events. Assertions, scores and counts are always derived from these, so no cache goes stale.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwright.functions import words

KEY = ["relation", "c1", "c2", "freq"]
#: What a statement's vote is on.
KINDS = ("sentence", "raw", "assertion")
_RAW = "relation string, freq string, frame string, surface1 string, surface2 string, creator long"
_VOTE = "kind string, object string, user_id long, vote int, at long"
_EVENT = "user_id long, object string, activity string, at long"


@dataclass(frozen=True)
class Base:
    raws: DataFrame  # relation, freq, frame, surface1, surface2, creator; one row per (surface1, surface2, frame)
    votes: DataFrame  # kind, object, user_id, vote, at; one row per (kind, object, user)
    surfaces: DataFrame  # surface, concept
    events: DataFrame  # user_id, object, activity, at


class Invalid(ValueError):
    """A statement or vote that breaks a rule."""


def empty(spark) -> Base:
    make = lambda schema: spark.createDataFrame([], schema).where(F.lit(False))  # noqa: E731  # known to be empty, so that no plan deals it
    return Base(make(_RAW), make(_VOTE), make("surface string, concept string"), make(_EVENT))


def raw_id() -> Column:
    return F.concat_ws("|", "frame", "surface1", "surface2")


def assertion_id() -> Column:
    return F.concat_ws("|", *KEY)


def linked(base: Base) -> DataFrame:
    """Raws with the concepts of their surfaces, their own id, their assertion's and their sentence."""
    s1 = base.surfaces.select(F.col("surface").alias("surface1"), F.col("concept").alias("c1"))
    s2 = base.surfaces.select(F.col("surface").alias("surface2"), F.col("concept").alias("c2"))
    rows = base.raws.join(s1, "surface1").join(s2, "surface2")
    sentence = F.replace(F.replace("frame", F.lit("{1}"), F.col("surface1")), F.lit("{2}"), F.col("surface2"))
    return rows.withColumns({"raw": raw_id(), "assertion": assertion_id(), "sentence": sentence})


def _last(votes: DataFrame) -> DataFrame:
    """One vote per user and object, the last; 0 takes it back."""
    last = votes.groupBy("kind", "object", "user_id").agg(F.max_by(F.struct("vote", "at"), F.struct("at", "vote")).alias("x"))
    return last.select("kind", "object", "user_id", "x.vote", "x.at").where("vote <> 0")


def check_votes(votes: DataFrame) -> None:
    """Votes are 1, 0 or -1."""
    bad = votes.where(~F.col("vote").isin(1, 0, -1) | F.col("vote").isNull()).limit(1).collect()
    if bad:
        raise Invalid(f"a vote must be 1, 0 or -1: {bad[0].vote}")


def vote(base: Base, votes: DataFrame, activity: str = "vote") -> Base:
    """Upserts votes (kind, object, user_id, vote, at) and logs an event each."""
    check_votes(votes)
    rows = votes.select("kind", "object", "user_id", F.col("vote").cast("int").alias("vote"), F.col("at").cast("long").alias("at"))
    events = rows.select("user_id", "object", F.lit(activity).alias("activity"), "at")
    return replace(base, votes=_last(base.votes.unionByName(rows)), events=base.events.unionByName(events))


def state(base: Base, statements: DataFrame, activity: str = "statement") -> Base:
    """Adds statements (user_id, relation, freq, frame, text1, text2, vote, at) in bulk.

    New surfaces and concepts appear, a raw that exists is used again, and the user's vote goes to
    the sentence, the raw and the assertion. Equal texts break the rule.
    """
    same = statements.where("text1 = text2").limit(1).collect()
    if same:
        raise Invalid(f"a statement needs two different texts: {same[0].text1}")
    new = statements.select(F.explode(F.array("text1", "text2")).alias("surface")).distinct()
    new = new.join(base.surfaces, "surface", "left_anti").select("surface", words.normal_form(F.col("surface")).alias("concept"))
    surfaces = base.surfaces.unionByName(new)
    rows = statements.select("relation", "freq", "frame", F.col("text1").alias("surface1"), F.col("text2").alias("surface2"), F.col("user_id").alias("creator"), "vote", "at")
    key = ["frame", "surface1", "surface2"]
    first = rows.groupBy(*key).agg(F.min_by(F.struct("relation", "freq", "creator"), F.struct("at", "creator")).alias("x"))
    first = first.select("x.relation", "x.freq", *key, "x.creator")
    raws = base.raws.unionByName(first.join(base.raws.select(*key), key, "left_anti").select(*base.raws.columns))
    out = replace(base, raws=raws, surfaces=surfaces)
    rows = rows.select(*base.raws.columns, "vote", "at")
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("object")) for kind in KINDS])
    said = linked(replace(out, raws=rows))
    votes = said.select(F.explode(each).alias("o"), F.col("creator").alias("user_id"), "vote", "at").select("o.*", "user_id", "vote", "at")
    done = vote(out, votes, activity)
    told = _told(base, rows).withColumn("kind", F.explode(F.array(*map(F.lit, KINDS))))
    named = F.coalesce(*[F.when(F.col("kind") == kind, F.col(kind)) for kind in KINDS])
    events = told.select(F.col("creator").alias("user_id"), named.alias("object"), F.lit(activity).alias("activity"), F.col("at").cast("long").alias("at"))
    return replace(done, events=base.events.unionByName(events))


def _told(base: Base, rows: DataFrame) -> DataFrame:
    """As `linked`, with the surfaces that `base` doesn't know at their normal forms: rows meet the surfaces that it knows, and nobody else's.

    Events are a log that is mostly counted: without a look at `object`, neither forms nor names are made.
    """
    for i in "12":
        known = base.surfaces.select(F.col("surface").alias(f"surface{i}"), F.col("concept").alias(f"c{i}"), F.lit(True).alias(f"known{i}"))
        rows = rows.where(F.col(f"surface{i}").isNotNull()).join(known, f"surface{i}", "left")
        rows = rows.withColumn(f"c{i}", F.when(F.col(f"known{i}"), F.col(f"c{i}")).otherwise(words.normal_form(F.col(f"surface{i}"))))
    sentence = F.replace(F.replace("frame", F.lit("{1}"), F.col("surface1")), F.lit("{2}"), F.col("surface2"))
    return rows.drop("known1", "known2").withColumns({"raw": raw_id(), "assertion": assertion_id(), "sentence": sentence})


def scores(base: Base, kind: str) -> DataFrame:
    """object and score; objects without votes are absent."""
    return base.votes.where(F.col("kind") == kind).groupBy("object").agg(F.sum("vote").alias("score"), F.count("vote").alias("n_votes"))


def score_of(base: Base, kind: str, name: str) -> tuple[int, int]:
    """Sum and count of an object's votes; (0, 0) without any."""
    row = base.votes.where((F.col("kind") == kind) & (F.col("object") == name)).agg(F.coalesce(F.sum("vote"), F.lit(0)).alias("s"), F.count("vote").alias("n")).first()
    return row.s, row.n


def assertions(base: Base) -> DataFrame:
    """The five keys with score, best raw (by score, then id) and its texts."""
    raw_scores = scores(base, "raw").select(F.col("object").alias("raw"), F.col("score").alias("raw_score"))
    rows = linked(base).join(raw_scores, "raw", "left").withColumn("raw_score", F.coalesce("raw_score", F.lit(0)))
    best = F.max_by(F.struct("raw", "surface1", "surface2"), F.struct(F.col("raw_score"), F.col("raw")))
    made = rows.groupBy("assertion", *KEY).agg(best.alias("b"))
    total = scores(base, "assertion").select(F.col("object").alias("assertion"), "score")
    return made.join(total, "assertion", "left").select("assertion", *KEY, F.coalesce("score", F.lit(0)).alias("score"), F.col("b.raw").alias("best_raw"), F.col("b.surface1").alias("best_surface1"), F.col("b.surface2").alias("best_surface2"))


def concepts(base: Base) -> DataFrame:
    """concept and num_assertions: assertions of positive score that touch it, a self-loop once."""
    useful = assertions(base).where("score > 0").select(F.explode(F.array_distinct(F.array("c1", "c2"))).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))
    known = base.surfaces.select("concept").distinct()
    return known.join(useful, "concept", "left").select("concept", F.coalesce("n", F.lit(0)).alias("num_assertions"))


def surface_counts(base: Base) -> DataFrame:
    """surface and use_count: raws with it at either side, at both once."""
    used = base.raws.select(F.explode(F.array_distinct(F.array("surface1", "surface2"))).alias("surface")).groupBy("surface").agg(F.count("*").alias("n"))
    return base.surfaces.join(used, "surface", "left").select("surface", "concept", F.coalesce("n", F.lit(0)).alias("use_count"))


def sentence_count(base: Base) -> int:
    return linked(base).select("sentence").distinct().count()


def move_surfaces(base: Base, moves: DataFrame) -> Base:
    """Surfaces go to other concepts (surface, concept); votes follow to the assertions that then hold their raws.

    Where a user has voted on both assertions, the vote on the one that was there stays.
    """
    to = moves.select("surface", F.col("concept").alias("__to"))
    surfaces = base.surfaces.join(to, "surface", "left").select("surface", F.coalesce("__to", "concept").alias("concept"))
    out = replace(base, surfaces=surfaces)
    return replace(out, votes=_rekeyed(base, out, "raw"))


def _rekeyed(before: Base, after: Base, by: str) -> DataFrame:
    """Votes with the assertions of `before` named as in `after`."""
    old = linked(before).select(F.col(by).alias("k"), F.col("assertion").alias("old")).distinct()
    new = linked(after).select(F.col(by).alias("k"), F.col("assertion").alias("new")).distinct()
    names = old.join(new, "k").where("old <> new").select("old", "new").distinct()
    mine = before.votes.where("kind = 'assertion'")
    moved = mine.join(names, mine.object == names.old, "left").withColumns({"own": F.col("new").isNull(), "object": F.coalesce("new", "object")})
    pick = F.max_by(F.struct("vote", "at"), F.struct("own", "at", "vote"))
    kept = moved.groupBy("kind", "object", "user_id").agg(pick.alias("x")).select("kind", "object", "user_id", "x.vote", "x.at")
    return before.votes.where("kind <> 'assertion'").unionByName(kept)


def relemmatised(base: Base) -> Base:
    """Surfaces whose concept isn't their normal form move to it."""
    wanted = base.surfaces.select("surface", words.normal_form(F.col("surface")).alias("to"), "concept").where("to <> concept")
    return move_surfaces(base, wanted.select("surface", F.col("to").alias("concept")))


def merge_duplicate_raws(raws: DataFrame, votes: DataFrame, key: list[str], weak_creator: int) -> tuple[DataFrame, DataFrame]:
    """Raws of equal key become one, and votes move to it unless their user has voted there.

    `raws` has raw_id, creator and the key; `votes` raw_id, user_id, vote. The survivor is the first
    raw that `weak_creator` didn't make, else the first.
    """
    order = Window.partitionBy(*key).orderBy((F.col("creator") == weak_creator).cast("int"), "raw_id")
    ranked = raws.withColumns({"rn": F.row_number().over(order), "keep": F.first("raw_id").over(order)})
    names = ranked.select("raw_id", "keep")
    moved = votes.join(names, "raw_id").select(F.col("keep").alias("raw_id"), "user_id", "vote", (F.col("raw_id") == F.col("keep")).alias("own"), F.col("raw_id").alias("from"))
    pick = F.max_by("vote", F.struct("own", F.negate("from")))
    return ranked.where("rn = 1").drop("rn", "keep"), moved.groupBy("raw_id", "user_id").agg(pick.alias("vote"))


def consecutive_duplicates(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows that equal the one before them in their key, in order, with that one's id."""
    before = F.lag(order).over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("before", before).where("before is not null")


def without_activity(base: Base, activity: str) -> Base:
    """Objects that an activity made lose the votes cast with it."""
    gone = base.events.where(F.col("activity") == activity).select("object", "user_id").distinct()
    return replace(base, votes=base.votes.join(gone, ["object", "user_id"], "left_anti"))


def without_user_on(base: Base, user_id: int, relation: str) -> Base:
    """A user's votes on a relation's assertions become none."""
    mine = (F.col("kind") == "assertion") & (F.col("user_id") == user_id) & F.col("object").startswith(relation + "|")
    return replace(base, votes=base.votes.where(~mine))


def initial_votes(raws: DataFrame, blocked: DataFrame) -> DataFrame:
    """A vote of 1 by its creator for each raw, none for raws with a blocked concept."""
    ids = ["raw_id", "creator"]
    bad = blocked.select(F.col("concept")).distinct()
    kept = raws.join(bad.withColumnRenamed("concept", "c1"), "c1", "left_anti").join(bad.withColumnRenamed("concept", "c2"), "c2", "left_anti")
    return kept.select(*ids).select("raw_id", F.col("creator").alias("user_id"), F.lit(1).alias("vote"))


def ratings_to_votes(ratings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ratings on a sentence, raw or assertion as votes of their sign, and events at the ratings' time."""
    target = F.coalesce("sentence", "raw", "assertion")
    kind = F.when(F.col("sentence").isNotNull(), "sentence").when(F.col("raw").isNotNull(), "raw").otherwise("assertion")
    rows = ratings.select(kind.alias("kind"), target.alias("object"), "user_id", F.signum("rating").cast("int").alias("vote"), "at").where("object is not null")
    return _last(rows), rows.select("user_id", "object", F.lit("rating").alias("activity"), "at")


def unswitched(rows: DataFrame) -> DataFrame:
    """Rows whose two texts stand crosswise to those of their sentence's reading, swapped back."""
    n = words.normal_form
    crossed = (n(F.col("text1")) == n(F.col("parsed2"))) & (n(F.col("text2")) == n(F.col("parsed1"))) & (n(F.col("text1")) != n(F.col("text2")))
    swap = lambda a, b: F.when(crossed, F.col(b)).otherwise(F.col(a))
    return rows.withColumns({"text1": swap("text1", "text2"), "text2": swap("text2", "text1"), "swapped": crossed})


def new_users(users: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds users (username); a name that is taken breaks the rule."""
    taken = wanted.join(users, "username", "left_semi").limit(1).collect()
    if taken:
        raise Invalid(f"the name is taken: {taken[0].username}")
    return users.unionByName(wanted.select("username").distinct())


def templated(rows: DataFrame) -> DataFrame:
    """Structured predicates (user_id, relation, polarity, frame, text1, text2, rating, at) as statements."""
    freq = F.when(F.col("polarity") < 0, "not").otherwise("")
    vote = F.signum("rating").cast("int")
    return rows.select("user_id", "relation", freq.alias("freq"), "frame", "text1", "text2", vote.alias("vote"), "at")
