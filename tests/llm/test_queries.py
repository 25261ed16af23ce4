"""The registered queries themselves, against brute force over whole tables, and their defined cases."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from conftest import SF
from meshwright.llm import ann, decontam, langid, license_scan, line_dedup, ngram_join, packing, pii, queries, shared, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "a b gram node n at same p line head token want sign share left right cell".split()


def frame(spark, rows, extra=False):
    data = [(i, t, None, None, None) for i, t in rows]
    df = spark.createDataFrame(data, DOCS)
    return df.withColumns({c: F.lit(1) for c in CLASHING}) if extra else df


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    return queries.QUERIES[name](spark, SF)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tokens(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text or ""))


def test_op1_and_op2_have_a_row_per_document(spark, texts):
    one, two = run(spark, "op1_ngram_jaccard").collect(), run(spark, "op2_line_dedup").collect()
    assert sorted(r.doc_id for r in one) == sorted(texts) == sorted(r.doc_id for r in two)
    for r in two:
        n = len(texts[r.doc_id].split("\n"))
        assert r.n_lines == n and r.n_removed == len(r.removed) and r.removed == sorted(set(r.removed)) and all(0 <= x < n for x in r.removed)
    assert sum(r.n_removed for r in two) > 0


def test_op3_digest(spark, texts):
    order = {k: i for i, k in enumerate(pii.KINDS)}
    for r in run(spark, "op3_pii").collect():
        spans = sorted((s[:3] for s in pii.find(texts[r.doc_id] or "")), key=lambda s: (order[s[0]], s[1]))
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in pii.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]


def test_pii_overlaps():
    rng = np.random.default_rng(3)
    spans = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 200, 30), rng.integers(1, 9, 30))]
    meets = pii._overlaps(spans)
    for b, e in itertools.product(range(0, 200, 3), (1, 4, 30)):
        assert meets(b, b + e) == any(b < y and x < b + e for x, y in spans)
    assert not pii._overlaps([])(0, 5)


def test_op4_kernel_is_that_of_sets(spark):
    some = ["Ein kurzer Satz", "a short sentence", "una frase", "a short Sentence!"]
    rows = langid.presence(some)
    marks = rows / np.sqrt(rows.sum(1, keepdims=True))
    got = rows @ marks.T / np.sqrt(rows.sum(1, keepdims=True))
    sets = [set(langid.features(t).tolist()) for t in some]
    want = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(got, want, atol=1e-5) and got[1, 3] > 0.9
    assert langid.has_letter("é") and not any(map(langid.has_letter, ("½ ² Ⅷ ①", "123", "", None)))
    held = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in run(spark, "op4_language_id").collect()}
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= s <= 1 for d, (h, _, s) in held.items())


def test_op4_learns_every_language(spark):
    rows = [(i, f"{w} {w}ing {i}", f"l{k:03}", None, 1) for k, w in enumerate(f"w{chr(97 + a)}{chr(97 + b)}x" for a in range(10) for b in range(8)) for i in range(k * 10, k * 10 + 10)]
    df = spark.createDataFrame(rows, DOCS)
    assert len(langid.fit(df).langs) == 80
    assert langid.fit(df.limit(0)) is None
    assert langid.identify(df.limit(0), None).count() == 0


def test_op5_rules_and_ratio(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    got = run(spark, "op5_url_filter").collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        _, sep, rest = (pages[r.page_id] or "").partition("://")
        host = lower(re.split("[/?#]", rest)[0]) if sep else ""
        path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]) :])[0] if sep else ""
        fits = [k for k in rules if (host == k.split("/")[0] or host.endswith("." + k.split("/")[0])) and path.startswith(k[k.index("/") :])]
        best = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best) and r.verdict in ("allow", "block")
        assert best is None or r.verdict == rules[best]
    long = spark.createDataFrame([(1, "http://a.example/" + "x" * 200_000, ""), (1, "http://a.example/", ""), (1, "http://a.example/", "")], "page_id long, url string, rule string")
    assert url_filter.judge(long).count() == 3


def test_op6_covers_every_id(spark, texts):
    held = {}
    for r in run(spark, "op6_packing").collect():
        held.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert held.keys() == texts.keys()
    for parts in held.values():
        parts.sort()
        assert sum(n for _, n, _ in parts) == parts[0][2] and [s for s, _, _ in parts] == [0, *itertools.accumulate(n for _, n, _ in parts)][:-1]
    rows = [(None, "a b"), (1, "a b"), (1, "a b")]
    pieces = packing.pack(frame(spark, rows, True), packing.tokenizer_path()).collect()
    assert sum(r.length for r in pieces) == 9 and all(r.doc_tokens == 3 for r in pieces)


def test_op6_ids_equal_the_tokenizers():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    random.seed(1)
    letters = "abcABC éÉüß\t\n\r .,!?'’\"-_()019 中日本 İıǅªº½ÀǾ\U0001f600<|>\x00\x0bst're'll"
    some = ["".join(random.choices(letters, k=random.randint(0, 60))) for _ in range(1500)] + ["<|endoftext|>", "", "  ", "don't", "A" * 500]
    chunks = packing.Chunks(whole)
    for part in (some[:700], some[700:], some[:700]):
        ids, ends = chunks.ids(pa.array(part))
        for text, a, b in zip(part, [0, *ends], ends):
            assert whole.encode(text, add_special_tokens=False).ids == ids[a:b].tolist(), text


def test_op7_reads_the_likeliest_path():
    """`restore` against all readings of short tokens."""
    terms = {"idiot*": 0.99, "scum": 0.98}
    lm = toxicity.language_model(np.zeros(28**3), terms)

    def readings(token):
        found = [(0.0, (26, 26), "", "")]
        for c in token:
            new = []
            letters = [(c, 0.0)] if c.isalpha() else [(x, toxicity.COST_LEET) for x in toxicity.LEET.get(c, "")]
            for cost, (a, b), last, out in found:
                for x, extra in letters:
                    s = ord(x) - 97
                    new.append((cost + extra + lm[(a * 28 + b) * 28 + s], (b, s), x, out + x))
                    if x == last:
                        new.append((cost + extra + toxicity.COST_REPEAT, (a, b), last, out))
                if c in toxicity.SEPARATORS:
                    new.append((cost + (toxicity.COST_MASK if letters else toxicity.COST_SEPARATOR), (a, b), last, out))
                elif not letters:
                    new.append((cost, (26, 26), "", out + " "))
                if not c.isalnum() and (letters or c in toxicity.SEPARATORS) and last:
                    new.append((cost + toxicity.COST_BREAK + lm[(a * 28 + b) * 28 + 26], (26, 26), "", out + " "))
            found = new
        return [(cost + lm[(a * 28 + b) * 28 + 26], out) for cost, (a, b), _, out in found]

    for token in ("1d10t", "s.c.u.m", "$cum", "scuum", "a1b", "id*ot", "sc-um", "x!y", "aa.bb"):
        best = min(c for c, _ in readings(token))
        assert toxicity.restore(token, lm) in {out for c, out in readings(token) if c < best + 1e-9}, token


def test_op7_long_runs_of_letters():
    terms = {"idiot*": 0.99, "aterribleverylongword": 0.9}
    scorer = toxicity.Scorer(terms, toxicity.language_model(np.zeros(28**3), terms))
    assert scorer.score(" ".join("xyz" * 3000), 0.02) < 0.5
    assert scorer.score(" ".join("qq" * 2000 + "idiot" + "qq"), 0.02) >= 0.5
    assert scorer.spelled("aterribleverylongword") == 0.9


def test_op7_query(spark, texts):
    got = run(spark, "op7_toxicity").collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_op8_recall_at_block_size(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 32)).astype(np.float64)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 400 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q in range(0, 20_000, 400):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hit >= 0.95 * 20 * 50


def test_op8_repeated_rows_and_dimensions(spark):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))] + [(100 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(30, 3)))]
    once = {(r.query_id, r.rank, r.vec_id) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()}
    assert {q for q, _, _ in once} == {0, 20, 40, 100, 120} and all((q < 100) == (v < 100) for q, _, v in once)
    twice = ann.search(spark.createDataFrame([*rows, rows[0], rows[0]], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in twice if r.query_id == 0) == sorted(x for x in once if x[0] == 0)
    assert sorted(r["rank"] for r in twice if r.query_id == 20) == list(range(1, 21))


def test_op9_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, "x1 y1"), (2, "x1 y1"), (3, "z1")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontam.decontaminate(frame(spark, [(1, "x1 y1"), (2, "z1 w")]), bench).collect()}
    assert got == {1: (2, 1, True), 2: (1, 1, True)}
    only = decontam.decontaminate(frame(spark, [(1, "x1 y1")]), bench.where("item_id is null")).first()
    assert (only.n_hit, only.n_items, only.contaminated) == (2, 0, True)


def test_op10_columns(spark, texts):
    for r in run(spark, "op10_license_scan").collect():
        w = tokens(texts[r.doc_id])
        places, labels = [], set()
        for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_empty_tables(spark):
    none = frame(spark, [], True)
    assert pii.find_spans(none).count() == 0 and license_scan.scan(none).count() == 0
    assert ngram_join.near_duplicates(none).count() == 0 and line_dedup.removed_lines(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(none, toxicity.fit(none, labels)).count() == 0


def test_folding_equals_lower_case_of_ascii(spark):
    """`folded` against its definition on every code point."""
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and c != 10]
    df = spark.createDataFrame([(c, "x" + c + "Y") for c in chars], "c string, t string").select("c", "t", line_dedup.folded(F.col("t")).alias("f"))
    bad = [r.c for r in df.where(F.col("f") != F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\r\x0b\x0c", "abcdefghijklmnopqrstuvwxyz    ")).collect()]
    assert not bad


def test_pipeline_on_repeats_extra_columns_and_long_texts(spark, tmp_path):
    w = " ".join(f"word{i}" for i in range(80))
    rows = [(1, w), (1, w), (2, w + " more"), (3, None), (4, ""), (None, "no id here at all"), (5, "long " * 60_000), (6, "clean text of its own that stays\nand a second line of it")]
    docs = frame(spark, rows, True)
    for name, stage in cp.STAGES[:-1]:
        columns = docs.columns
        docs = shared.cut(stage(spark, docs, SF))
        assert docs.columns == columns, name
    kept = [r.doc_id for r in docs.select("doc_id").collect()]
    assert {3, 4, 5, 6, None} <= set(kept) and 2 not in kept and 1 in kept
    assert cp.STAGES[-1][1](spark, docs, SF).count() >= len(kept)
    empty = frame(spark, [], True)
    for _, stage in cp.STAGES[:-1]:
        empty = shared.cut(stage(spark, empty, SF))
    assert cp.STAGES[-1][1](spark, empty, SF).count() == 0
