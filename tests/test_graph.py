"""Registered queries against their SQL, and scalar functions against fixed cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF
from meshwright.functions import scalars as fn
from meshwright.operators import maintenance, traversal, voting
from meshwright.plans import registry
from meshwright.streaming import ledger
from meshwright.streaming import votes as stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in table)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert [one(spark, fn.edge_value(lit(s), lit(v))) for s, v in ((1, 10), (3, 5), (0, 7), (-4, 7))] == [1.0, 1.0, 0.0, 0.0]
    assert [one(spark, fn.adverb_value(lit(t))) for t in ("almost never", "", "foo", "usually always")] == [-10, 5, 5, 8]
    assert one(spark, fn.fill_in(lit("{1} is {%}{2}"), lit("a"), lit("b"))) == "a is b"
    assert [fn.clamp_limit(150), fn.clamp_limit(150, over=20), fn.clamp_limit(7), fn.clamp_limit(None)] == [100, 20, 7, 20]
    assert tuple(one(spark, fn.dependency(lit("nsubj(runs-2, dog-1)")))) == ("nsubj", "runs", 2, "dog", 1)
    assert one(spark, fn.dependency(lit("bad"))) is None


def test_last_vote_and_ends(spark):
    log = spark.createDataFrame([(1, "x", 1, 1), (1, "x", -1, 2), (2, "x", 1, 1), (2, "x", 0, 2), (3, "y", 1, 1)], "user_id int, o string, vote int, ts int")
    kept = voting.last_votes(log, "user_id", ["o"], ["ts"])
    assert {(r.user_id, r.o, r.vote) for r in kept.collect()} == {(1, "x", -1), (3, "y", 1)}
    top = voting.top_objects(kept, spark.createDataFrame([("x",)], "o string"), ["o"])
    assert top.collect() == []  # y is best but missing; x is below 0


def test_probabilistic_or(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.2), (2, 0.0), (3, 1.0), (3, 0.3)], "k int, s double")
    got = {r.k: round(r.s, 9) for r in df.groupBy("k").agg(traversal.probabilistic_or(F.col("s")).alias("s")).collect()}
    assert got == {1: 0.75, 2: 0.2, 3: 1.0}


def test_frame_merges(spark):
    frames = spark.createDataFrame([(1, "r", "t", 1, ""), (2, "r", "t", 3, ""), (3, "r", "u", 1, "")], "frame_id int, relation string, text string, goodness int, freq string")
    assert {(r.frame_id, r.keep) for r in maintenance.frame_merges(frames).collect()} == {(1, 2), (2, 2), (3, 3)}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ledger.follow(stream.event_votes(source), ["object_id"], ["ts", "event_id"], str(tmp_path / "log"), str(tmp_path / "state"), salts=3).awaitTermination(240)
    got = {tuple(r) for r in ledger.scores(spark.read.parquet(str(tmp_path / "log")), ["object_id"]).collect()}
    votes = voting.last_votes(stream.event_votes(events), "user_id", ["object_id"], ["ts", "event_id"])
    assert got == {tuple(r) for r in voting.scores(votes, ["object_id"]).collect()}
