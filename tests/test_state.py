"""Keyed state, stored versions, indexed frame matches, fixpoints and high ranks."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from meshwright.operators import extraction, matrix, spectral
from meshwright.sources import store
from meshwright.sources.graph import Graph
from meshwright.streaming import ledger

VOTES = "a string, b string, user_id long, vote int, t long, n long"


class Feed:
    """A folder that votes come into, and the log that follows it."""

    def __init__(self, spark, folder, salts=2):
        self.spark, self.folder, self.salts, self.came = spark, folder, salts, []

    def send(self, rows):
        self.came += rows
        self.spark.createDataFrame(rows, VOTES).coalesce(1).write.mode("append").parquet(str(self.folder / "in"))
        source = self.spark.readStream.schema(VOTES).parquet(str(self.folder / "in"))
        ledger.follow(source, ["a", "b"], ["t", "n"], str(self.folder / "log"), str(self.folder / "state"), self.salts).awaitTermination(240)

    @property
    def log(self):
        return self.spark.read.parquet(str(self.folder / "log"))

    def check(self):
        gone, last = {}, {}
        for a, b, user, vote, t, n in self.came:
            if user is None:
                gone[a, b] = max(gone.get((a, b), (t, n)), (t, n))
        for a, b, user, vote, t, n in self.came:
            if user is not None and (t, n) > gone.get((a, b), (-1, -1)) and (t, n) > last.get((a, b, user), (-1, -1, 0))[:2]:
                last[a, b, user] = t, n, vote
        want = {}
        for (a, b, _), (_, _, vote) in last.items():
            score, voters = want.get((a, b), (0, 0))
            want[a, b] = score + vote, voters + (vote != 0)
        got = {(r.a, r.b): (r.score, r.n_votes) for r in ledger.scores(self.log, ["a", "b"]).collect()}
        assert got == {k: v for k, v in want.items() if v[1]}
        count = {}
        for (a, b), (score, _) in want.items():
            for c in {a, b}:
                count[c] = count.get(c, 0) + (score > 0)
        assert {r.concept: r.num_assertions for r in ledger.counts(self.log, ["a", "b"]).collect()} == {c: n for c, n in count.items() if n}


def test_ledger_late_repeated_deleted_and_restarted(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.send([("x", "y", 1, 1, 10, 0), ("x", "y", 2, 1, 10, 1), ("x", "x", 1, 1, 5, 0), ("z", "y", 3, -1, 7, 0)])
    feed.check()
    before = feed.log.count()
    # late (9), repeated (10, 0), changed, taken back and new; each run starts again from the checkpoint
    feed.send([("x", "y", 1, -1, 9, 0), ("x", "y", 1, 1, 10, 0), ("z", "y", 3, 1, 8, 0), ("x", "x", 1, 0, 6, 0)])
    feed.check()
    assert feed.log.where("a = 'x' and b = 'y'").count() == 1  # the late and the repeated vote changed nothing
    assert feed.log.count() == before + 2  # only what was touched is written
    feed.send([("x", "x", 1, 1, 5, 5)])  # late against what was taken back
    feed.check()
    feed.send([("x", "y", None, 0, 20, 0), ("x", "y", 4, 1, 21, 0), ("x", "y", 5, 1, 19, 0)])
    feed.check()
    feed.send([("x", "y", 6, 1, 15, 0), ("x", "y", 1, 1, 22, 0)])  # a vote from before the deletion comes later
    feed.check()


def test_ledger_equals_recount_on_random_votes(spark, tmp_path):
    rng = random.Random(3)
    feed = Feed(spark, tmp_path, salts=4)
    for _ in range(2):
        user = lambda: None if rng.random() < 0.02 else rng.randrange(8)
        feed.send([(rng.choice("abc"), rng.choice("abc"), user(), rng.choice([1, 1, 0, -1]), rng.randrange(60), i) for i in range(150)])
        feed.check()


def test_counts_read_only_the_log(spark, tmp_path):
    Feed(spark, tmp_path).send([("x", "y", 1, 1, 10, 0)])
    plan = ledger.counts(spark.read.parquet(str(tmp_path / "log")), ["a", "b"])
    assert all("/log/" in f for f in plan.inputFiles())


def test_stored_tables_follow_their_source(spark, tmp_path):
    source = str(tmp_path / "source")
    write = lambda n: spark.range(n).select(F.col("id").alias("k")).write.mode("overwrite").parquet(f"{source}/t.parquet")
    built = []

    def table():
        def build():
            built.append(1)
            return spark.read.parquet(f"{source}/t.parquet")

        return store.stored(spark, source, "t", build, ["k"])

    write(5)
    assert table().count() == 5 and table().count() == 5 and len(built) == 1
    write(7)  # in the same session
    assert table().count() == 7 and len(built) == 2


def test_hub_values_are_split(spark):
    rows = Graph(spark, SF).assertions
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "90")
        by = store.stored(spark, SF, "assertions_by_c2 in parts", lambda: rows, ["c2", "relation", "c1"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = [r["count"] for r in by.groupBy(F.input_file_name()).count().collect()]
    hub = rows.groupBy("c2").count().agg(F.max("count")).first()[0]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2] and hub > max(sizes)


def brute_match(sentence, frames):
    text = sentence.strip(". ")
    for i, frame, goodness in sorted(frames, key=lambda f: (-f[2], f[0])):
        found = goodness >= 2 and re.compile(frame.replace("{%}", "").replace("{1}", "(.+)").replace("{2}", "(.+)").strip(". ")).match(text)
        if found:
            return i, found.group(1), found.group(2)
    return None, None, None


def test_frames_by_index_match_as_tried_one_by_one(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    frames = [(i, f"{{1}} {word()} {{%}} {word()} {{2}}", rng.choice([1, 2, 3])) for i in range(5000)]
    frames += [(6000, "{1}s are {2}", 3), (6001, "{1} is {2}", 2), (6002, "so {1}?x {2} now", 2), (6003, "{1}, {2}", 2), (6004, "{1} can {2} at last.", 4), (6005, "{2} of {1}", 2)]
    sentences = [f"the {word()} {f[1].split()[1]}  {f[1].split()[3]} {word()} ." for f in rng.sample(frames[:5000], 60)]
    sentences += ["dogs are here.", "a is b", "so my x y now", "x, y", "it can go at last", "it can go at lasting", "part of it", "", "nothing", "a is b"]
    df = spark.createDataFrame([(s,) for s in sentences], "sentence string")
    listed = spark.createDataFrame(frames, "frame_id int, text string, goodness int")
    got = sorted(tuple(r) for r in extraction.frame_matches(df, listed).select("sentence", F.coalesce("frame_id", F.lit(-1)), F.coalesce("text1", F.lit("-")), F.coalesce("text2", F.lit("-"))).collect())
    want = []
    for s in sentences:
        i, a, b = brute_match(s, frames)
        want.append((s, -1 if i is None else i, "-" if i is None else a, "-" if i is None else b))
    assert got == sorted(want)


def test_squished_reaches_a_fixpoint(spark):
    rng = random.Random(7)
    rows = {(f"c{int(rng.paretovariate(0.6)) % 60}", f"f{int(rng.paretovariate(0.6)) % 60}") for _ in range(500)}
    rows |= {(f"chain{i}", f"link{i + j}") for i in range(12) for j in range(3)}
    cells = spark.createDataFrame([(c, "right", "R", f, 1.0) for c, f in rows], "concept string, direction string, relation string, other string, value double")
    for cutoff in (2, 3, 5):
        left = set(rows)
        while True:
            near = lambda i: {x for x in {r[i] for r in left} if sum(r[i] == x for r in left) >= cutoff}  # noqa: E731, B023
            kept = {r for r in left if r[0] in near(0) and r[1] in near(1)}
            if kept == left:
                break
            left = kept
        assert {(r.concept, r.other) for r in matrix.squished(cells, cutoff).collect()} == left


@pytest.mark.parametrize("block", [7, 2048])
def test_singular_vectors_of_many_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(spectral, "BLOCK", block)
    monkeypatch.setattr(spectral, "FAN", 2)
    rng = np.random.default_rng(1)
    a = np.where(rng.random((40, 33)) < 0.3, rng.normal(size=(40, 33)), 0)
    cells = spark.createDataFrame([(f"r{i}", f"c{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a))], "r string, c string, value double")
    found = spectral.decompose(cells, "r", "c", 12)
    assert found.residual <= 1e-6
    want = np.linalg.svd(a)
    assert np.allclose(found.values, want[1][:12], rtol=1e-6)
    u = np.zeros((40, 12))
    for r in found.vectors.collect():
        u[int(r.r[1:])] = r.v
    assert np.allclose(u.T @ u, np.eye(12), atol=1e-6)
    assert np.allclose(np.abs((u * want[0][:, :12]).sum(0)), 1, atol=1e-3)
    full = spectral.decompose(cells, "r", "c", 40)  # more than the rank: the rest is 0
    assert np.allclose(full.values[:33], want[1], atol=1e-6) and np.allclose(full.values[33:], 0, atol=1e-6)
