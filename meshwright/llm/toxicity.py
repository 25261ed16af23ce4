"""Toxicity of texts whose abusive words may be disguised.

A noisy channel restores words: leetspeak signs stand for letters, separators may
stand inside a word or end it, letters may be repeated, and single letters in a row,
framed or not, may spell one word. The lattice of a token's readings is decoded with Viterbi under a character
trigram model that mixes the corpus (counts over all documents) with the abusive
terms that were learned; the restored text is then scored. A token whose lattice has
a single path restores to itself.

Terms are words and word beginnings (PREFIXES letters) that occur in labelled toxic
rows and hardly elsewhere. They are learned from at most TRAIN_ROWS rows of either
label, chosen by a hash of doc_id. A text's score combines its terms' precisions as
independent causes, over the rate of texts without terms.

Defined cases: null and empty texts have no term and get that base rate; without
labelled rows of both kinds there are no terms, so nothing is rejected; rows with a null doc_id
aren't held out; a doc_id labelled twice is toxic if one label says so; repeated rows
each get a row.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

TRAIN_ROWS = 4000
PREFIXES = (4, 5, 6)
TERMS = 4000
#: A term needs this precision, and a log-likelihood gain over the toxic rate that chance
#: doesn't give among a million candidates.
GAIN, PRECISION = 14.0, 0.85
#: And it stands in this share of the toxic sample rows: near copies share rare words and labels,
#: so that a few rows of one group would look like evidence.
SUPPORT = 0.005
CACHE = 300_000
#: The score of a text without any term.
BASE = 0.02
#: Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "*": "aeiou", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*'~^/\\"
#: Costs, as negative logs, of reading a sign as a letter, dropping a separator, and dropping a repeated letter.
COST_LEET, COST_SEPARATOR, COST_REPEAT = 0.7, 0.7, 1.5
#: Cost of a sign that may be dropped or stand for a letter but ends a word, besides the model's cost of that end.
COST_BREAK = 0.7
#: A separator that may also stand for a letter is dropped less readily.
COST_MASK = 1.6
_A = 28  # letters, word edge, other letter
_EDGE, _OTHER = 26, 27
_SPLIT = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[0-9@$!|+(€£¡.\-_*'~^/\\]|(.)\1")
_BREAKS = re.compile(r"[.\-_'~^/\\]+")
#: What may frame a token; the second set leaves signs that may stand for a letter.
_FRAMES = (".,;:!?\"'()[]{}<>&#%*$-_/\\|+~^", ".,;:?\"'()[]{}<>&#%-_/\\~^")


def _index(letter: str) -> int:
    code = ord(letter) - 97
    if 0 <= code < 26:
        return code
    base = ord(unicodedata.normalize("NFD", letter)[0].lower()) - 97
    return base if 0 <= base < 26 else _OTHER


class Symbols(dict):
    def __missing__(self, letter: str) -> int:
        self[letter] = value = _index(letter)
        return value


_SYMBOL = Symbols()
_BYTE_SYMBOL = np.full(256, _OTHER, np.int64)
for _b in range(128):
    _c = chr(_b).lower()
    _BYTE_SYMBOL[_b] = ord(_c) - 97 if "a" <= _c <= "z" else _EDGE


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Character trigrams of all texts, as counts by code; each task sends its non-zero cells."""

    def run(batches):
        total = np.zeros(_A**3, np.int64)
        for batch in tx.slices(batches, "text"):
            line = np.frombuffer(b" ".join(t for t in tx.byte_texts(batch.column(0)) if t), np.uint8)
            s = _BYTE_SYMBOL[line]
            if len(s) > 2:
                total += np.bincount((s[:-2] * _A + s[1:-1]) * _A + s[2:], minlength=_A**3)
        cells = np.flatnonzero(total)
        yield pa.record_batch([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "cell long, n long")
    table = np.zeros(_A**3)
    for r in found.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r.cell] = r.n
    return table


def _term_counts(terms: dict[str, float]) -> np.ndarray:
    table = np.zeros(_A**3)
    for term in terms:
        s = [_EDGE, _EDGE, *(_SYMBOL[c] for c in term.rstrip("*"))] + ([] if term.endswith("*") else [_EDGE])
        for a, b, c in zip(s, s[1:], s[2:]):
            table[(a * _A + b) * _A + c] += 1
    return table


def language_model(corpus: np.ndarray, terms: dict[str, float]) -> np.ndarray:
    """Negative log P(c | a, b): half the corpus model, half the model of the terms."""

    def conditional(table: np.ndarray) -> np.ndarray:
        n = table.reshape(_A * _A, _A)
        two = n.reshape(_A, _A, _A).sum(0)
        one = (two.sum(0) + 1) / (two.sum() + _A)
        low = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
        return (n + 5 * np.tile(low, (_A, 1))) / (n.sum(1, keepdims=True) + 5)

    return -np.log((conditional(corpus) + conditional(_term_counts(terms))) / 2).ravel()


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a token (lower case) under the channel and `model`."""
    states: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(_EDGE, _EDGE, ""): (0.0, None)}
    for c in token:
        after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

        def reach(state, cost, path):
            if state not in after or cost < after[state][0]:
                after[state] = (cost, path)

        letters = [(c, 0.0)] if c.isalpha() else [(x, COST_LEET) for x in LEET.get(c, "")]
        ends = _is_sign(c) and (bool(letters) or c in SEPARATORS)
        for (a, b, last), (cost, path) in states.items():
            for letter, extra in letters:
                s = _SYMBOL[letter]
                reach((b, s, letter), cost + extra + model[(a * _A + b) * _A + s], (letter, path))
                if letter == last:
                    reach((a, b, last), cost + extra + COST_REPEAT, path)
            if c in SEPARATORS:
                reach((a, b, last), cost + (COST_MASK if letters else COST_SEPARATOR), path)
            elif not letters:  # a sign with no reading ends the word
                reach((_EDGE, _EDGE, ""), cost, (" ", path))
            if ends and last:
                reach((_EDGE, _EDGE, ""), cost + COST_BREAK + model[(a * _A + b) * _A + _EDGE], (" ", path))
        states = after
    ends = [(cost + model[(a * _A + b) * _A + _EDGE], path) for (a, b, _), (cost, path) in states.items()]
    path, out = min(ends, key=lambda e: e[0])[1], []
    while path:
        letter, path = path
        out.append(letter)
    return "".join(reversed(out))


def _is_sign(c: str) -> bool:
    """A word may begin behind it."""
    return not c.isalnum()


def _parts(token: str) -> list[str]:
    """A token split at the signs that always end a word."""
    return "".join(c if c.isalpha() or c in LEET or c in SEPARATORS else " " for c in token).split()


def _starts(word: str) -> list[tuple[int, str]]:
    """Where words may begin, from the left, and the skeleton of what follows."""
    out, shape = [], ""
    for i in range(len(word) - 1, -1, -1):
        x = LEET.get(word[i], word[i])[0]
        if x.isalpha() and x not in "aeiouyl" and not shape.startswith(x):
            shape = (x + shape)[:2]
        if not i or _is_sign(word[i - 1]):
            out.append((i, shape))
    return out[::-1]


def _single(token: str) -> str:
    """The single character that a token consists of, but for what frames it."""
    if len(token) == 1 or token.isalnum():
        return token if len(token) == 1 else ""
    return next((core for core in map(token.strip, reversed(_FRAMES)) if len(core) == 1), "")


def _skeleton(word: str) -> str:
    """The first two consonants but l, without repetition: the same for all disguises of a word."""
    out: list[str] = []
    for c in word:
        x = LEET.get(c, c)[0]
        if x.isalpha() and x not in "aeiouyl" and (not out or out[-1] != x):
            out.append(x)
            if len(out) == 2:
                break
    return "".join(out)


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


class Scorer(dict):
    """The strongest term precision of each token, kept for the tokens seen lately."""

    def __init__(self, terms: dict[str, float], model: np.ndarray):
        super().__init__()
        # a list of floats is read faster than an array, one at a time
        self.terms, self.model = terms, model.tolist()
        self.longest = max(map(len, terms), default=0)
        self.shapes = {_skeleton(t.rstrip("*")) for t in terms}
        self.open = tuple(x for x in self.shapes if len(x) < 2)

    def word(self, word: str) -> float:
        return max((self.terms.get(f, 0.0) for f in features(word)), default=0.0)

    def words(self, text: str) -> float:
        return max(map(self.word, _SPLIT.findall(text)), default=0.0)

    def __missing__(self, token: str) -> float:
        best = self.words(token)
        if not best and _ODD.search(token):
            for core in {part.strip(frame) for part in _parts(token) for frame in _FRAMES}:
                if _ODD.search(core):
                    begin = next((i for i, shape in _starts(core) if shape in self.shapes or shape.startswith(self.open)), None)
                    if begin is None:
                        continue
                    # what stands between separators may also be a word of its own
                    own = [x for x in _BREAKS.split(core[begin:]) if _ODD.search(x) and ((shape := _skeleton(x)) in self.shapes or shape.startswith(self.open))]
                    best = max([best, *(self.words(restore(x, self.model)) for x in {core[begin:], *own})])
        if len(self) >= CACHE:
            self.clear()
        if len(token) <= 64:
            self[token] = best
        return best

    def spelled(self, letters: str) -> float:
        """Of single characters in a row: the strongest term anywhere in what they spell."""
        text = restore(letters, self.model)
        # terms are bounded in length, so every place has a bounded number of them
        whole = (text[i:j] for i in range(len(text)) for j in range(i + 1, min(len(text), i + self.longest) + 1))
        begun = (text[i : i + n] + "*" for i in range(len(text)) for n in PREFIXES if i + n <= len(text))
        return max((self.terms.get(f, 0.0) for f in chain(whole, begun)), default=0.0)

    def score(self, text: str, rate: float) -> float:
        tokens = text.lower().split()
        found = [p for p in map(self.__getitem__, set(tokens)) if p]
        letter = {i: c for i, c in enumerate(map(_single, tokens)) if c}
        single = list(letter)
        if len(single) > 2:
            run = [single[0]]
            for i in [*single[1:], None]:
                if i is not None and i == run[-1] + 1:
                    run.append(i)
                    continue
                if len(run) > 2:
                    found += [p for p in [self.spelled("".join(letter[j] for j in run))] if p]
                run = [i]
        clean = 1 - rate
        for p in sorted(found):
            clean *= 1 - p
        return 1 - clean


class Model:
    def __init__(self, terms: dict[str, float], rate: float, lm: np.ndarray):
        self.terms, self.rate, self.lm = terms, rate, lm


def _labels(labels: DataFrame) -> DataFrame:
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return rows.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _signed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """With the least hash of three words in a row: near copies mostly share it, so they count once."""
    least = []
    for text in tx.byte_texts(batch.column(0)):
        words = (text or b"").translate(tx.FOLD_CASE).split()
        least.append(min((zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))), default=0))
    return pa.record_batch([*batch.columns, pa.array(least, pa.int64())], names=["text", "toxic", "sign"])


def learn_terms(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[dict[str, float], float]:
    """Terms with their precision, and the score of texts without a term."""
    place = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    known = _labels(labels).where(tx.id_bucket("doc_id", 5) != 0)
    count = {bool(r.toxic): r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(count) < 2:
        return {}, BASE
    share = {y: min(1.0, rows / n) for y, n in count.items()}
    chosen = known.where(place < F.when(F.col("toxic") == 1, share[True]).otherwise(share[False]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most about 2 * rows ids, so the list may go to every task
    sample = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    sample = tx.map_slices(sample, "text", lambda: _signed, "text string, toxic int, sign long").dropDuplicates(["sign", "toxic"])

    def run(batches):
        toxic, clean = Counter(), Counter()
        for batch in tx.slices(batches, "text"):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w for w in _SPLIT.findall((text or "").lower())}
                (toxic if y else clean).update({f for w in words if len(w) > 2 for f in features(w)} | {""})
        names = list(toxic.keys() | clean.keys())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([clean[f] for f in names], pa.int64())], names=["f", "t", "c"])

    stats = sample.mapInArrow(run, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    whole = stats.where("f = ''").collect()
    if not whole or not whole[0].t or not whole[0].c:
        return {}, BASE
    n_toxic, n_clean = whole[0].t, whole[0].c
    # clean rows were sampled more thinly; weigh them as in the labelled rows
    weight = (count[False] / n_clean) / (count[True] / n_toxic)
    clean, base = weight * F.col("c"), count[True] / (count[True] + count[False])
    precision = F.col("t") / (F.col("t") + clean + 0.2)
    gain = F.col("t") * F.log(precision / base) + clean * F.log((1 - precision) / (1 - base))
    strong = stats.where(F.col("f") != "").where((F.col("t") > 1) & (F.col("t") >= SUPPORT * n_toxic) & (precision >= PRECISION) & (gain >= GAIN))
    rows = strong.select("f", precision.alias("p"), "t").orderBy(F.desc("t"), "f").limit(TERMS).collect()
    support = {r.f: r.t for r in rows}
    # a beginning gives way to a longer one that explains as many rows, and covers other terms that start with it
    longer = {f for f in support if f.endswith("*") and any(g.endswith("*") and g != f and g[:-1].startswith(f[:-1]) and t >= 0.98 * support[f] for g, t in support.items())}
    starts = tuple(f[:-1] for f in support if f.endswith("*") and f not in longer)
    terms = {r.f: r.p for r in rows if r.f not in longer and not any(r.f != s + "*" and r.f.startswith(s) for s in starts)}
    return terms, BASE


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    terms, rate = learn_terms(docs, labels, rows)
    return Model(terms, rate, language_model(trigram_counts(docs), terms))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        scorer, rate = Scorer(shared.value.terms, shared.value.lm), shared.value.rate

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [scorer.score(t or "", rate) for t in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), batch.column(2), pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(tx.id_bucket("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    out = tx.map_slices(rows, "text", task, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean_documents(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text scores under `limit`, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer, rate = Scorer(shared.value.terms, shared.value.lm), shared.value.rate
        for batch in tx.slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([scorer.score(t or "", rate) < limit for t in texts], pa.bool_()))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: a score for every document."""
    docs = tx.documents(spark, sf_dir)
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
