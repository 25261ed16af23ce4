"""Versions of tables, work in batches, block documents and coloured texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.operators import batches, colours, versions
from meshwright.sources import files

AT = lambda day: F.lit(f"2020-01-{day:02}").cast("timestamp_ntz")


def table(spark, rows):
    return spark.createDataFrame(rows, "k int, a string, b double")


def test_stamps_move_only_with_their_row(spark):
    first = versions.stamped(table(spark, [(1, "x", 1.0), (2, None, 2.0), (3, "z", None), (None, "n", 0.0)]), ["k"], AT(1))
    assert {(r.k, r.created.day, r.updated.day) for r in first.collect()} == {(1, 1, 1), (2, 1, 1), (3, 1, 1), (None, 1, 1)}
    # 1 stays, 2 changes from null, 3 isn't saved, the null key changes, 4 comes twice
    second = table(spark, [(1, "x", 1.0), (2, "", 2.0), (None, "m", 0.0), (4, "q", 4.0), (4, "q", 4.0)])
    got = {r.k: (r.a, r.b, r.created.day, r.updated.day) for r in versions.saved(first, second, ["k"], AT(2)).collect()}
    assert got == {1: ("x", 1.0, 1, 1), 2: ("", 2.0, 1, 2), 3: ("z", None, 1, 1), None: ("m", 0.0, 1, 2), 4: ("q", 4.0, 2, 2)}
    assert {(r.k, r.change) for r in versions.changes(first, second, ["k"]).collect()} == {(2, "changed"), (3, "deleted"), (None, "changed"), (4, "inserted")}
    third = versions.saved(versions.saved(first, second, ["k"], AT(2)), second, ["k"], AT(3))
    assert third.where(F.day("updated") == 3).count() == 0
    assert versions.changes(first, first.drop("created", "updated", "digest"), ["k"]).count() == 0
    none = table(spark, [])
    assert versions.saved(versions.stamped(none, ["k"], AT(1)), none, ["k"], AT(2)).count() == 0


def test_batches_go_on_where_they_stopped(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("x"))
    seen = []

    def work(fail):
        def run(df):
            seen.append(df.agg(F.min("id") % 5).first()[0])
            if fail and len(seen) == 3:
                df.write.mode("overwrite").parquet(str(tmp_path / "job" / "results" / "batch=2"))  # half of a result
                raise RuntimeError("stopped")
            return df.select("id", (F.col("x") * 2).alias("y"))

        return run

    job = batches.Batches(spark, str(tmp_path / "job"), "double").prepare(rows, F.col("id") % 5)
    with pytest.raises(RuntimeError):
        job.run(work(True))
    record = {r.batch: (r.status, r.progress_num, r.progress_den) for r in job.record().collect()}
    assert record == {b: ("done", 20, 20) if b < 2 else ("waiting", 0, 20) for b in range(5)}
    again = batches.Batches(spark, str(tmp_path / "job"), "double").prepare(rows.limit(0), F.col("id") % 5)
    out = again.run(work(False))
    assert sorted(map(tuple, out.collect())) == [(i, i % 7 * 2) for i in range(100)]
    assert sorted(seen) == [0, 1, 2, 2, 3, 4] and again.record().where("status = 'done'").count() == 5
    before = len(seen)
    again.run(work(False))
    assert len(seen) == before  # all is done


def test_block_documents_over_splits(spark, tmp_path):
    hard = ["one", "", "two\nlines", "\nstarts\n\nand ends\n", "--- \nmodel: x\npk: 1\nfields:\n  text: |", "  text: y", "tail\n--- ", 'quote " \\ tab\t', "|\n    deep", None, "ä 🙂\r\nb", "null"]
    rows = [(i, t, i * 0.5 if i % 3 else None, [t, "x"] if i % 2 else None) for i, t in enumerate(hard * 40)]
    df = spark.createDataFrame(rows, "id long, text string, n double, parts array<string>")
    path = str(tmp_path / "docs")
    files.blocks_out(df, "note", "id").coalesce(1).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")  # splits fall inside documents and separators
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = files.blocks_in(spark, path, "text string, n double, parts array<string>")
        assert got.rdd.getNumPartitions() > 5
        assert sorted((int(r.pk), r.text, r.n, r.parts) for r in got.collect()) == sorted(rows, key=lambda r: r[0])
        assert {r.model for r in got.collect()} == {"note"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


UNITS = [("red", [1.0, 0.0]), ("blue", [0.0, 1.0])]


def brute_mix(v):
    if v is None:
        return 128, 128, 128
    size = sum(x * x for x in v) ** 0.5
    cube = [((sum(a * b for a, b in zip(v, c)) / size) ** 3 if size else 0.0) for _, c in UNITS]
    out = (0, 0, 0)
    for w, (name, _) in zip(cube, UNITS):
        share = w / sum(cube) if sum(cube) else 0.0
        out = tuple(min(max(int(share * c + o), 0), 255) for c, o in zip(colours.RGB[name], out))
    return out


def test_coloured_texts(spark):
    words = {"fire": [3.0, 0.0], "sea": [0.0, 2.0], "dusk": [2.0, 1.0], "cold": [-1.0, 2.0], "void": [0.0, 0.0]}
    texts = [(1, "The Fire at dusk\n\nsea  sea void"), (2, ""), (3, None), (4, "nothing here"), (5, "cold " * 300 + "fire")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    vectors = spark.createDataFrame(list(words.items()), "concept string, v array<double>")

    def block(line):
        shown, found = [], []
        for w in line.split(" "):
            v = words.get(w.lower())
            found += [v] if v else []
            size = sum(x * x for x in v) ** 0.5 if v else 0
            strong = v and size and abs(sum(v) / size) >= 1
            shown.append('<span style="background-color: rgb({},{},{})">{}</span>'.format(*brute_mix(v), w) if strong else w)
        colour = brute_mix([sum(x) for x in zip(*found)] if found else None)
        return '<div style="background-color: rgb({},{},{}); padding: 1ex;">{}</div>'.format(*colour, " ".join(shown))

    got = {r.doc_id: r.html for r in colours.coloured_texts(df, vectors, UNITS).collect()}
    assert got == {i: "\n".join(map(block, t.split("\n"))) for i, t in texts if t is not None}


def test_coloured_texts_of_frequent_and_rare_words(spark, monkeypatch):
    words = [f"w{i}" for i in range(40)]
    texts = [(i, "\n".join(" ".join(words[(i * j * k) % 40] for k in range(1, 9)) for j in range(1, 5)) + "  unknown") for i in range(20)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    vectors = spark.createDataFrame([(w, [float(i), 1.0]) for i, w in enumerate(words)], "concept string, v array<double>")
    whole = {r.doc_id: r.html for r in colours.coloured_texts(df, vectors, UNITS).collect()}
    monkeypatch.setattr(colours, "OFTEN", 3)
    assert len(whole) == 20 and whole == {r.doc_id: r.html for r in colours.coloured_texts(df, vectors, UNITS).collect()}


def test_a_colour_takes_one_pass_for_each_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(colours.mixed(F.col("v"), UNITS).alias("c"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(") <= len(UNITS) + 1


def test_colours_learned_from_a_blend(spark):
    rng = np.random.default_rng(2)
    graph = [(f"w{i}", "right", "IsA", f"k{j}", float(rng.random())) for i in range(12) for j in range(5) if rng.random() < 0.6]
    cells = spark.createDataFrame(graph, "concept string, direction string, relation string, other string, value double")
    contexts = [("w1", "red"), ("w2", "red"), ("w3", "blue"), ("w4", "blue"), ("red", "red")]
    vectors, found = colours.learned(cells, spark.createDataFrame(contexts, "word string, colour string"), k=30, tol=1e-9)
    got = {r.concept: np.array(r.v) for r in vectors.collect()}
    # the same with dense arrays
    said = {}
    for w, c in contexts:
        for f, x in ((f"right|HasColor|{c}", 10), ("right|HasProperty|colorful", 10), (f"right|HasProperty|{c}", 10)):
            said[w, f] = said.get((w, f), 0) + x
    for c in ("red", "blue"):
        for f in (f"right|HasColor|{c}", f"right|HasProperty|{c}"):
            said[c, f] = said.get((c, f), 0) + 50
    parts = [said, {(c, f"{d}|{r}|{o}"): v for c, d, r, o, v in graph}]
    names, features = sorted({k[0] for p in parts for k in p}), sorted({k[1] for p in parts for k in p})
    a = np.zeros((len(names), len(features)))
    for p in parts:
        m = np.zeros_like(a)
        for (c, f), v in p.items():
            m[names.index(c), features.index(f)] = v
        rows, cols = (np.sqrt((m**2).sum(axis)) for axis in (1, 0))
        a += 0.5 * np.divide(m, np.sqrt(np.outer(rows, cols)), out=np.zeros_like(m), where=m != 0)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    wu, wv = u * s, vt.T * s
    for x in names:  # products don't depend on the signs of singular vectors
        for c, v in found:
            want = wu[names.index(x)] @ (0.1 * wu[names.index(c)] + wv[features.index(f"right|HasColor|{c}")])
            assert abs(got[x] @ np.array(v) - want) < 1e-4
    assert [c for c, _ in found] == ["blue", "red"]
    coloured = {r.concept: (r.r, r.g, r.b) for r in colours.coloured_concepts(vectors, found).collect()}
    assert coloured["red"][0] > coloured["red"][2] and coloured["w3"][2] > coloured["w3"][0]
