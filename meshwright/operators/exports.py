"""Export rows; write them with `df.write.text` or `df.write.csv`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.functions import scalars as fn
from meshwright.operators import lookups
from meshwright.sources.graph import HIDDEN, ORDER, Graph


def denormalised(g: Graph) -> DataFrame:
    """Assertions with their names, scores and wording, for CSV."""
    names = lookups.best_surface(g)
    n1 = names.select(F.col("concept").alias("c1"), F.col("canonical_name").alias("name1"))
    n2 = names.select(F.col("concept").alias("c2"), F.col("canonical_name").alias("name2"))
    return lookups.render(g).join(n1, "c1").join(n2, "c2").select("relation", "c1", "c2", "freq", "name1", "name2", "sentence")


def n3(g: Graph) -> DataFrame:
    """A line for each useful assertion, and one for each concept that these name."""
    safe = lambda c: F.replace(F.col(c), F.lit('"'), F.lit("_"))
    edges = g.useful.select(F.format_string('<#%s> <%s> <#%s> . # "%s" %d', fn.quoted(F.col("c1")), F.col("relation"), fn.quoted(F.col("c2")), safe("freq"), F.col("score")).alias("line"))
    ends = g.useful.select(F.explode(F.array("c1", "c2")).alias("text")).distinct()
    known = g.concepts.join(ends, "text", "left_semi")
    return edges.unionByName(known.select(F.format_string('<#%s> <name> "%s" .', fn.quoted(F.col("text")), safe("text")).alias("line")))


def triples(g: Graph) -> DataFrame:
    """Reified statements: seven (subject, predicate, object) rows for each useful assertion."""
    node = F.concat_ws("|", "relation", "c1", "c2", "freq")
    pair = lambda p, o: F.struct(F.lit(p).alias("predicate"), o.alias("object"))
    rows = F.array(
        pair("type", F.lit("Statement")), pair("subject", F.col("c1")), pair("predicate", F.col("relation")), pair("object", F.col("c2")),
        pair("score", F.col("score").cast("string")), pair("frequency", F.col("freq")), pair("value", F.col("value").cast("string")),
    )
    return g.useful.select(node.alias("subject"), F.explode(rows).alias("x")).select("subject", "x.predicate", "x.object")


def edge_list(g: Graph) -> DataFrame:
    """c1, c2 and a JSON object of the edge's data, for a tab-separated file."""
    data = F.to_json(F.struct(F.col("relation").alias("rel"), "score", "freq"))
    return g.useful.where("c1 <> c2").select("c1", "c2", data.alias("data"))


def urls(g: Graph) -> DataFrame:
    """Each concept's address."""
    return g.concepts.select("text", F.concat(F.lit("/en/concept/"), F.replace(fn.quoted(F.col("text")), F.lit("%20"), F.lit("+")), F.lit("/")).alias("url"))


def raw_rows(g: Graph) -> DataFrame:
    """Raw assertions with an id and their wording."""
    key = F.concat_ws("|", "relation", "c1", "c2", "freq", F.col("frame_id").cast("string"))
    return g.raws.withColumns({"id": key, "text": fn.fill_in(F.col("frame"), F.trim("surface1"), F.trim("surface2"))})


def dated_sentences(g: Graph) -> DataFrame:
    """Sentences with when and by what they came: a voted one with its first vote, as a statement or a denial; others by import, undated."""
    first = F.min_by(F.struct("vote", "l_shipdate"), F.struct(*ORDER)).alias("x")
    born = g.vote_log.groupBy("c1", "c2").agg(first).select(F.lit("CapableOf").alias("relation"), "c1", "c2", F.col("x.l_shipdate").alias("created_on"), F.when(F.col("x.vote") > 0, "statement").otherwise("denial").alias("activity"))
    rows = raw_rows(g).join(born, ["relation", "c1", "c2"], "left")
    return rows.select("id", "creator", "created_on", F.coalesce("activity", F.lit("import")).alias("activity"), "text")


def addresses(g: Graph) -> DataFrame:
    """kind, address and short text of assertions, raw assertions and concepts."""
    path = lambda kind, key: F.concat(F.lit(f"/en/{kind}/"), F.replace(fn.quoted(key), F.lit("%20"), F.lit("+")), F.lit("/")).alias("url")
    key = F.concat_ws("|", "relation", "c1", "c2", "freq")
    a = g.useful.select(F.lit("assertion").alias("kind"), path("assertion", key), F.format_string("%s(%s, %s)[%s]", "relation", "c1", "c2", "freq").alias("text"))
    raw = F.concat_ws("|", key, F.col("frame_id").cast("string"))
    r = g.raws.select(F.lit("raw_assertion").alias("kind"), path("raw_assertion", raw), F.format_string("en: ('%s' %s '%s') s=%d", "surface1", "relation", "surface2", "score").alias("text"))
    c = g.concepts.select(F.lit("concept").alias("kind"), path("concept", F.col("text")), F.format_string("<en: %s>", "text").alias("text"))
    return a.unionByName(r).unionByName(c)


def gml(g: Graph) -> DataFrame:
    """A line of GML for each node and each edge of the network."""
    edges = g.useful.where("c1 <> c2")
    nodes = edges.select(F.explode(F.array("c1", "c2")).alias("t")).distinct()
    node = F.format_string('node [ id "%s" label "%s" ]', "t", "t")
    edge = F.format_string('edge [ source "%s" target "%s" rel "%s" score %d freq "%s" ]', "c1", "c2", "relation", "score", "freq")
    return nodes.select(node.alias("line")).unionByName(edges.select(edge.alias("line")))


def n3_frames(g: Graph) -> DataFrame:
    """A line for each frame that raw assertions use."""
    used = g.raws.select("frame_id").distinct()
    text = F.replace("text", F.lit('"'), F.lit("_"))
    return g.frames.join(used, "frame_id", "left_semi").select(F.format_string('<frame/%d> RelationType <%s>; FrameText "%s"; FrameGoodness "%d".', "frame_id", "relation", text, "goodness").alias("line"))


def reified(g: Graph) -> DataFrame:
    """Eleven (subject, predicate, object) rows for each raw assertion of a useful assertion."""
    rows = raw_rows(g).where("assertion_score > 0").where(~F.col("c1").isin(HIDDEN) & ~F.col("c2").isin(HIDDEN))
    said = [
        ("type", F.lit("Statement")), ("subject", F.col("c1")), ("predicate", F.col("relation")), ("object", F.col("c2")), ("LeftText", F.col("surface1")), ("RightText", F.col("surface2")),
        ("FrameId", F.col("frame_id")), ("Language", F.lit("en")), ("Creator", F.col("creator")), ("Score", F.col("score")), ("Sentence", F.col("text")),
    ]
    each = F.array(*[F.struct(F.lit(p).alias("predicate"), o.cast("string").alias("object")) for p, o in said])
    return rows.select(F.col("id").alias("subject"), F.explode(each).alias("x")).select("subject", "x.predicate", "x.object")


def coloured(rows: DataFrame, rgb: list[tuple[str, int, int, int]]) -> DataFrame:
    """text and html: the text on the colour that its similarities mix."""
    mix = fn.colour_mix(F.col("sims"), rgb)
    return rows.select("text", mix.alias("c")).select("text", F.format_string('<span style="background: rgb(%d,%d,%d)">%s</span>', "c.r", "c.g", "c.b", "text").alias("html"))


def tables(g: Graph) -> dict[str, DataFrame]:
    """The tables of a publication. Of users only the id and a name go out: all else is blank."""
    said = raw_rows(g)
    kinds, activities = [("assertion",), ("raw_assertion",), ("sentence",)], [("vote",), ("import",)]
    users = g.votes.select("user_id").distinct().select("user_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"))
    blank = {c: F.lit("") for c in ("first_name", "last_name", "email")}
    users = users.withColumns(blank | {"password": F.lit("X"), "last_login": F.lit(_NEVER).cast("timestamp"), "date_joined": F.lit(_NEVER).cast("timestamp"), "is_staff": F.lit(False), "is_active": F.lit(True), "is_superuser": F.lit(False)})
    return {
        "vote": g.votes, "raw_assertion": g.raws, "frame": g.frames, "surface_form": g.surfaces, "assertion": g.assertions, "relation": g.relations, "frequency": g.frequencies,
        "concept": g.concepts, "language": g.languages, "sentence": said.select("text", "creator", "score").distinct(), "user": users,
        "content_type": g.spark.createDataFrame(kinds, "name string"), "activity": g.spark.createDataFrame(activities, "name string"),
        "batch": g.spark.createDataFrame([], "batch int, status string, remarks string, progress_num long, progress_den long, created timestamp, updated timestamp"),
    }


#: Fixed value: the time that stands for every user's own.
_NEVER = "1969-12-31 19:00:00"


def dump(g: Graph, path: str) -> DataFrame:
    """Every table of `tables` as Parquet under `path`, over what was there; the list of them as they were read back."""
    out = None
    for name, df in tables(g).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        back = g.spark.read.schema(df.schema).parquet(f"{path}/{name}")
        row = back.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(",".join(sorted(back.columns))).alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out
