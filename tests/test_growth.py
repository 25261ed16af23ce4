"""Work that must not grow faster than the tables: what is kept, read once or left out."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF
from meshwright.llm import ngram_join, packing
from meshwright.operators import extraction, matrix, spectral, voting, writes
from meshwright.sources.graph import Graph
from meshwright.streaming import ledger


def test_sentences_of_one_shape_are_read_once():
    found = extraction.Parser()
    told = [f"Supplier#{i:09d} can make {w} anvil".split() for i in range(50) for w in ("blue", "large")]
    assert all(found.parse(words) == extraction.Parser().parse(words) for words in told[:4])
    assert len({str(found.parse(words)) for words in told}) <= 2 and found.read.cache_info().misses <= 2
    named = ["a join of dogs".split(), "a part of dogs".split()]  # words that the grammar names differ from others
    assert [found.parse(w) for w in named] == [extraction.Parser().parse(w) for w in named]


def test_a_repeated_sentence_is_read_once_and_kept_as_often(spark):
    rows = spark.createDataFrame([("a dog is a kind of animal",), (None,), ("what",), ("a dog is a kind of animal",), (None,)], "sentence string")
    key = [F.coalesce(c, F.lit("-")) for c in ("sentence", "relation", "text1", "text2")]
    got, want = (sorted(tuple(r) for r in f(rows).select(*key).collect()) for f in (extraction.parsed_once, extraction.parsed))
    assert got == want and len(got) == 5


def test_votes_are_kept_by_one_shuffle_without_python_and_null_places_come_first(spark, tmp_path):
    schema = "a string, user_id long, vote int, t long, n long"
    for rows in ([("x", 1, -1, None, 0), ("x", 1, 1, 3, 0), ("y", 2, 1, None, 1), ("y", None, 0, 9, 0)], [("x", 1, -1, None, 5), ("y", 2, 1, 9, 0), ("y", 3, 1, 9, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ledger.follow(source, ["a"], ["t", "n"], str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination(240)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert {tuple(r) for r in ledger.scores(log, ["a"]).collect()} == {("x", 1, 1), ("y", 1, 1)}
    plan = ledger.tallied(spark.createDataFrame([], schema), None, ["a"], ["t", "n"])._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "transformWithState" not in plan


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_a_move_groups_only_the_votes_that_meet(spark):
    votes = spark.createDataFrame([(1, "old", "x", 1), (1, "new", "x", -1), (2, "old", "x", 1), (3, None, "x", 1), (3, "far", "x", -1)], "user_id long, c1 string, c2 string, vote int")
    moved = voting.moved_votes(votes, "c1", "old", "new", ["c1", "c2"])
    assert {tuple(r) for r in moved.collect()} == {(1, "new", "x", -1), (2, "new", "x", 1), (3, None, "x", 1), (3, "far", "x", -1)}
    grouped = _plan(moved).split("Aggregate")[-1]
    assert "Filter" in grouped and "old,new" in grouped.replace(" ", "")


def test_quads_are_summed_before_they_become_two_cells(spark):
    quads = spark.createDataFrame([("a", "R", "b", 1.0), ("a", "R", "b", 2.0), ("b", "R", "a", 4.0), ("a", "R", "a", 8.0)], "c1 string, relation string, c2 string, value double")
    cells = matrix.summed_cells(quads)
    want = {("a", "right", "R", "b", 3.0), ("b", "left", "R", "a", 3.0), ("b", "right", "R", "a", 4.0), ("a", "left", "R", "b", 4.0), ("a", "right", "R", "a", 8.0), ("a", "left", "R", "a", 8.0)}
    assert {tuple(r) for r in cells.collect()} == want and _plan(cells).find("Generate") < _plan(cells).find("Aggregate")


def test_votes_are_sorted_once(spark):
    g = Graph(spark, SF)
    seen = []
    g.stored = lambda name, build, by=None: seen.append(build()) or seen[0]
    assert {r.freqs for r in g._user_votes.select("freqs").distinct().collect()} <= set(range(1, 8))
    plan = _plan(seen[0])
    assert "Exchange" in plan and "Exchange" not in plan[: plan.find("Aggregate")] and plan.find("Exchange") > plan.rfind("Aggregate")


def test_a_python_worker_keeps_few_words_and_pieces():
    texts = [" ".join(f"w{i}" for i in range(at, at + 1000)).encode() for at in range(0, 120_000, 1000)]
    sets = ngram_join.shingle_sets(texts)
    assert len(ngram_join._HASHES) <= 100_000 and packing.CACHE <= 200_000
    again = ngram_join.shingle_sets(texts[:1])
    assert (sets[0] == again[0]).all() and len(sets) == 120


def test_what_a_product_sends_grows_with_the_names(spark, monkeypatch):
    monkeypatch.setattr(spectral, "BLOCK", 64)
    rng, met = np.random.default_rng(5), {}
    for many in (300, 1200):
        hubs = [(f"s{i}", f"hub{h}", 1.0 + (i * int(h)) % 7) for i in range(many) for h in rng.choice(20, 5, replace=False)]
        cells = spark.createDataFrame(hubs + [(c, r, v) for r, c, v in hubs], "r string, c string, value double")
        tiles = spectral.Tiles.of(cells, "r", "c", spectral.Scratch(spark))
        met[many] = tiles.pairs["rb"].count()
    assert met[1200] <= 4.5 * met[300]  # 16 times as many when hubs lie in all blocks
    found = spectral.decompose(cells, "r", "c", 4)
    names = {n: i for i, n in enumerate(sorted({r for r, _, _ in hubs} | {c for _, c, _ in hubs}))}
    dense = np.zeros((len(names), len(names)))
    for r, c, v in hubs:
        dense[names[r], names[c]] = dense[names[c], names[r]] = v
    assert np.allclose(found.values, np.linalg.svd(dense, compute_uv=False)[:4]) and found.rounds <= 2


def test_few_frames_are_tried_without_a_shuffle(spark, monkeypatch):
    frames = spark.createDataFrame([(1, "{1} is {2}", 3), (2, "{1} is a {2}", 4), (3, "{1} is {%} made of {2}", 3), (4, "no {1} of {2}", 1), (5, None, 3)], "frame_id int, text string, goodness int")
    said = spark.createDataFrame([("A dog is a pet.",), ("it is red",), ("",), (None,), ("no end of it",), ("it is  made of tin.",), ("it is red",)], "sentence string")
    few = extraction.frame_matches(said, frames)
    assert "Exchange" not in _plan(few) and "Join" not in _plan(few)
    got = {r.sentence: tuple(r)[1:] for r in few.collect()}
    monkeypatch.setattr(extraction, "FEW", 2)
    many = extraction.frame_matches(said, frames)
    assert got == {r.sentence: tuple(r)[1:] for r in many.collect()} and few.count() == 7 and few.schema == many.schema
    assert got["A dog is a pet."] == (2, "A dog", "pet") and got["no end of it"] == (None, None, None)


def test_events_of_statements_are_counted_without_dealing_the_votes(spark):
    said = [(1, "IsA", "", "{1} is a {2}", "the dogs", "pet", 1, 1), (2, "IsA", "", "{1} is a {2}", "the dogs", "pet", -1, 2), (2, "IsA", "", "{1} is a {2}", "cat", None, 1, 3)]
    rows = spark.createDataFrame(said, "user_id long, relation string, freq string, frame string, text1 string, text2 string, vote int, at long")
    first = writes.state(writes.empty(spark), rows)
    assert {tuple(r) for r in first.events.groupBy("user_id").count().collect()} == {(1, 3), (2, 3)}
    plan = first.events.groupBy("user_id").count()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "regexp" not in plan
    moved = writes.move_surfaces(first, spark.createDataFrame([("pet", "friend")], "surface string, concept string"))
    again = writes.state(moved, rows.where("vote = 1")).events.where("activity = 'statement'")
    key = ["user_id", "object", "at"]
    want = [(1, o, 1) for o in ("the dogs is a pet", "{1} is a {2}|the dogs|pet", "IsA|dog|pet|", "IsA|dog|friend|")]
    assert {tuple(r) for r in again.where("user_id = 1").select(*key).collect()} == set(want)


def test_a_bounded_search_finds_the_same_readings_from_fewer_spans(spark, monkeypatch):
    class Ones(dict):
        def get(self, *_):
            return 1.0

    p = extraction.Parser()
    all_nodes = {x: [-1 - node for node in nodes] for x, nodes in p.begins.items()}
    later = {x: [node for node in nodes if -1 - node < p.first_pattern] for x, nodes in all_nodes.items()}
    pushed, push = [0], extraction.heapq.heappush
    monkeypatch.setattr(extraction.heapq, "heappush", lambda *a: pushed.__setitem__(0, pushed[0] + 1) or push(*a))
    rng, counts = np.random.default_rng(3), [0, 0]
    words = "a dog is not used to the of red and , you can running sings birds to want in plam glorp when has".split()
    said = spark.read.parquet(f"{SF}/conversations.parquet").where("text is not null").orderBy("conv_id", "turn").limit(60)
    said = [s for r in said.collect() if 0 < len(extraction.tokenize(s := r.text.split(". ")[0])) <= 24]
    odd = ["a dog is a kind of animal", "you can use a saw to cut wood", "when you sleep , you dream", ", ,", "the"]
    odd += [" ".join(rng.choice(words, n)) for n in range(1, 20) for _ in range(3)]
    for sentence in [*said, *odd]:
        kinds = tuple(p.kind(w, i == 0) for i, w in enumerate(extraction.tokenize(sentence)))
        ones = [1.0] * (len(kinds) + 1)
        pushed[0] = 0
        whole = p._above(kinds, 0.0, [Ones(), all_nodes, later], ones, ones)
        counts[0] += pushed[0] * (sentence in said)
        pushed[0] = 0
        assert p._read(kinds) == whole, sentence
        counts[1] += pushed[0] * (sentence in said)
    assert len(said) > 20 and counts[1] < 0.8 * counts[0], counts
