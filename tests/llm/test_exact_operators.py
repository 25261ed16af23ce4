"""Top-k search, fill-in-middle and centroid clustering: brute force, SQL and defined cases."""

import hashlib
import itertools
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF
from meshwright.llm import ann, centroids, fim, line_dedup, ngram_join, pii, queries, topk_search

VECS, SF01 = "vec_id long, embedding array<float>", SF.replace("sf0.001", "sf0.01")


@pytest.mark.parametrize("name", ["op11_topk_search", "op12_fill_in_middle", "op13_centroid_clustering"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert got and sorted(map(repr, map(tuple, got))) == sorted(map(repr, cursor.fetchall()))


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, VECS)
    names = "v d cid qk own ids tau list part local key id asks rb qb rn score seen rank vec query_id cluster distance n s j far".split()
    return df.withColumns({c: F.lit("x") for c in names}) if clash else df


# top-k


def brute_topk(rows, k, every, scale=256):
    import math

    good = {(i, tuple(math.floor(scale * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for qi, q in good:
        if qi % every:
            continue
        found = {}
        for i, v in good:
            if i != qi and len(v) == len(q):
                found.setdefault(i, []).append(sum(a * b for a, b in zip(q, v)))
        scored = sorted(((-s, i) for i, many in found.items() for s in many))[:k]
        out += [(qi, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def searched(df, every, k=5, lists=2):
    return sorted(tuple(r) for r in topk_search.search(df, F.col("vec_id") % every == 0, k, lists).collect())


def test_topk_defined_cases(spark):
    rng = np.random.default_rng(1)
    common = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, common) for i in range(40)]  # one vector that many rows share: ties by id
    rows += [(i, rng.normal(size=4).round(1).tolist()) for i in range(40, 70)]
    rows += [(70, None), (71, []), (72, [1.0, None, 2.0, 1.0]), (73, [float("nan")] * 4), (74, [float("inf")] * 4), (None, common), (75, [0.0] * 4), (76, [1.0, 2.0]), (80, [2.0, 1.0]), (80, [])]
    rows += [(50, common), (50, common), (60, rows[60][1])]  # repeated rows, and an id with two vectors
    for lists in (1, 2, 3):
        assert searched(frame(spark, rows), 10, lists=lists) == brute_topk(rows, 5, 10)
    assert searched(frame(spark, []), 10) == []
    assert searched(frame(spark, [(0, common)]), 10) == []  # no other row
    assert searched(frame(spark, [(0, [1e12]), (1, [1.0]), (10, [1.0])]), 10) == [(10, 1, 1, 65536)]  # products that no long holds


def test_topk_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "ROWS", 30)
    monkeypatch.setattr(topk_search, "QUERIES", 7)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=9) * (1 + i % 3)).tolist()) for i in range(200)]
    for lists in (2, 4):
        assert searched(frame(spark, rows, False), 5, 3, lists) == brute_topk(rows, 3, 5)


def test_topk_large_components_stay_exact(spark):
    rows = [(i, [float((i * 37 + j * 11) % 101 - 50) * 1000.0 for j in range(6)]) for i in range(30)]
    assert searched(frame(spark, rows, False), 5) == brute_topk(rows, 5, 5)
    wide = np.array([[1 << 30, 3], [5, 1 << 29]])
    assert topk_search._exact(wide, wide) is np.int64 and topk_search._exact(wide[:, 1:], wide[:, 1:] * 0) is np.float64


def test_cutoff_is_safe():
    for tau, lists in itertools.product(range(-20, 21), (1, 2, 3, 4)):
        cut = int(topk_search.cutoff(np.array([tau]), lists)[0])
        assert cut * lists >= tau > (cut - 1) * lists  # lists of less than cut add up to less than tau


def test_op8_recall_against_exact_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF01}/embeddings.parquet'")
    want = {(q, v): s for q, _, v, s in con.execute(ann.EXACT).fetchall()}
    got = {(r.query_id, r.vec_id): r.score for r in queries.QUERIES["op8_nearest_neighbours"](spark, SF01).collect()}
    assert len(got) == len(want) and len(got.keys() & want.keys()) >= 0.95 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got.keys() & want.keys())


# fill-in-middle

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", " ", "a", " a", "a ", "ä  b\t\nc", "x <P> y", "<P", "<", "<<P>", "< P>", "<M>", "a<S>b", "\x0b\x0c", "   x", "日本 語 🙂", "<P <S <M tail", "P> S> >"]


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in ("key", "n", "i", "form", "chunk", "output", "at0", "side")})


@pytest.mark.parametrize("giant", [1 << 30, 0])
def test_fim_defined_cases(spark, giant):
    rows = [(i, t) for i, t in enumerate(TEXTS * 6)] + [(None, "no id here"), (5, "again and again"), (5, "again and again"), (6, "other text")]
    rows += [(1000 + i, " ".join(["lorem", "<", "ipsum  ", "dolor\n"] * 50)) for i in range(8)]
    for size in (1, 2, 3, 7, 1 << 18):
        df = fim.transform(docs(spark, rows), size=size, giant=giant)
        back = df.withColumn("text", fim.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(map(repr, (tuple(r)[:6] for r in back))) == sorted(repr(brute_fim(*r)) for r in rows)
        assert sorted(r.text for r in back) == sorted(t or "" for _, t in rows)
    assert fim.transform(docs(spark, []), giant=giant).count() == 0


def test_fim_long_text_over_chunks(spark):
    rows = [(i, "wört <x  " * 40_000 + "end" * (i % 2)) for i in range(6)]
    for giant in (1 << 30, 1000):
        got = fim.transform(docs(spark, rows), size=5_000, giant=giant).collect()
        assert sorted(map(tuple, got)) == sorted(brute_fim(*r) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text("<PSM> a\n", max_size=30), st.lists(st.integers(0, 30), max_size=6))
def test_scan_composes(text, cuts):
    data = text.encode()
    edges = [0, *sorted(c for c in cuts if c <= len(data)), len(data)]
    whole = fim.NOTHING
    for a, b in zip(edges, edges[1:]):
        whole = whole.then(fim.scan(data[a:b]))
    for state in range(4):  # against the automaton, byte by byte
        s, tokens, marks = state, 0, 0
        for c in data:
            tokens, marks, s = tokens + fim.ENDS[s, c], marks + fim.SENTINELS[s, c], fim.AFTER[s, c]
        assert (whole.exit[state], whole.tokens[state], whole.marks[state]) == (s, tokens, marks)
    assert whole.tokens[fim.SPACE] + bool(data) == len(TOKEN.findall(text))
    assert bool(whole.marks[fim.SPACE]) == any(m in text for m in ("<P>", "<S>", "<M>"))


# clustering


def brute_clusters(rows, k=16, rounds=3, dim=64, scale=64):
    import math

    pts = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in pts)
    centres = [v for _, v in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        mine = [near(v)[1] for _, v in pts]
        for j in range(len(centres)):
            own = [v for (_, v), m in zip(pts, mine) if m == j]
            if own:
                centres[j] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, *near(v)) for i, v in pts]
    inertia = sum(d for _, d, _ in found)
    return sorted((i, j, d, sum(e for _, e, c in found if c == j), inertia, hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found)


def clustered(df, **how):
    points = centroids.kept(df, **{k: v for k, v in how.items() if k == "dim"})
    found = centroids.assign(points, centroids.fit(points, **how))
    return sorted((r.vec_id, r.cluster, r.distance, int(r.cluster_inertia), int(r.inertia), r.centroid_sha256) for r in found.collect())


def test_clustering_defined_cases(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) * (1 + i % 3)).tolist()) for i in range(60)]
    rows += [(100, None), (101, []), (102, [1.0] * 63), (103, [None] + [1.0] * 63), (104, [float("nan")] * 64), (105, [float("-inf")] * 64), (None, [1.0] * 64)]
    rows += [rows[3], rows[3], (7, rows[8][1])] + [(200 + i, rows[5][1]) for i in range(30)]  # repeated rows, ids and one common vector
    assert clustered(frame(spark, rows)) == brute_clusters(rows)
    few = rows[:5]
    assert clustered(frame(spark, few)) == brute_clusters(few)
    assert clustered(frame(spark, [])) == [] and clustered(frame(spark, [(1, None)])) == []
    same = [(i, [0.5] * 64) for i in range(20)]  # all centroids equal: the smallest number wins
    assert {r[1] for r in clustered(frame(spark, same))} == {0}


def test_partial_distances_find_the_nearest():
    rng = np.random.default_rng(5)
    for spread in (1, 3, 50):
        x, c = rng.integers(-spread, spread + 1, (300, 20)), rng.integers(-spread, spread + 1, (9, 20))
        for chunk in (1, 3, 16, 20):
            cluster, distance = centroids.nearest(x, c, rng.permutation(20), chunk)
            every = ((x[:, None] - c) ** 2).sum(2)
            assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()


# near copies with a template that many rows share, and signs between digits


def test_templates_with_unique_ends(spark):
    """Members of hot buckets whose kinds can't reach the bound leave them; real copies in the same buckets are found."""
    rows = [(i, f"the page you want was not found x{i}") for i in range(400)]
    rows += [(1000 + i, f"see the page you want here and there once more or never again at all {'tail ' * 12}{i // 2}") for i in range(40)]
    rows += [(2000 + i, f"a line of ten words that ends in other ways w{i % 7} v{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [(i, shingles(t)) for i, t in rows]
    similar = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[k + 1 :] if 4 * len(x & y) >= 3 * len(x | y)]
    root = {i: i for i, _ in rows}
    for a, b in sorted(similar) * 3:
        root[a] = root[b] = min(root[a], root[b])
    gone = set()
    for (i, x), k in zip(sets, range(len(sets))):
        if any(4 * len(x & y) >= 3 * len(x | y) for _, y in sets[:k]):
            gone.add(i)
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df).collect()} == root
    assert {r.doc_id for r in line_dedup.removed_lines(df).collect()} == gone


def test_national_numbers_have_one_of_three_signs():
    for text in ("call now: 1999!123 4567", "phone 030.1234 56789", "call 0123,456 7890", "tel 030'1234 56789"):
        assert not [s for s in pii.find(text) if s[0] == "local_phone"]
    for text in ("phone 030 1234 56789", "phone 030/1234 56789", "phone 030-1234-56789"):
        assert [s for s in pii.find(text) if s[0] == "local_phone"]
