"""URL filters: rules, and a character language-model ratio where no rule fits.

Rules name a host with its subdomains and a path prefix; the longest fitting rule
decides. The URLs that rules allow and those that they block train two smoothed
variable-order Markov models over a small fixed alphabet: an interpolated model of
orders 0 to 3 (Witten-Bell weights, from the counts of all these URLs). A URL's score
is the difference of its two log-likelihoods divided by its length. The threshold
is calibrated on the rule-decided URLs of one hash fold in four, under models of the
other three folds, so that both kinds of error are equally frequent.

The count table has at most ALPHABET ** 4 cells a class whatever the input, so the
driver and the broadcast hold a bounded table.

Defined cases: a null url, or one without `://`, has an empty host and path, no rule,
and the method's verdict on its text; without rule-decided URLs of both classes
every undecided URL is allowed; repeated rows each get their own row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

#: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Symbols: 0 ends a URL; then letters, one for all digits, punctuation, one for the rest.
_MARKS = "./-_?=&%#:~+,;@"
ALPHABET = 1 + 26 + 1 + len(_MARKS) + 1
ORDER = 3
FOLDS = 4

_SYMBOL = np.full(256, ALPHABET - 1, np.int64)
for _b in range(256):
    _c = chr(_b).lower()
    if "a" <= _c <= "z":
        _SYMBOL[_b] = 1 + ord(_c) - ord("a")
    elif "0" <= _c <= "9":
        _SYMBOL[_b] = 27
    elif _c in _MARKS:
        _SYMBOL[_b] = 28 + _MARKS.index(_c)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty if it is null or has no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path and the deciding rule and its verdict, or nulls."""
    host, path = parts(F.col("url"))
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    out = out.withColumns({"host": host, "path": path})
    rule = verdict = None
    for kind, name, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(prefix)
        rule = F.when(fits, name + prefix) if rule is None else rule.when(fits, name + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return out.withColumns({"rule": none if rule is None else rule, "decided": none if verdict is None else verdict})


def symbols(urls: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """4-gram codes of all URLs' symbols with their ends, and the URL of each."""
    gap = np.zeros(ORDER, np.int64)
    rows = [_SYMBOL[np.frombuffer(u or b"", np.uint8)] for u in urls]
    if not rows:
        return gap[:0], gap[:0]
    line = np.concatenate([x for r in rows for x in (gap, r)] + [gap])
    sizes = np.array([len(r) + 1 for r in rows])
    begins = np.concatenate(([0], np.cumsum(sizes + ORDER - 1)))[:-1] + ORDER
    at = np.repeat(begins - np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes) + np.arange(sizes.sum())
    code = np.zeros(len(at), np.int64)
    for back in range(ORDER, -1, -1):
        code = code * ALPHABET + line[at - back]
    return code, np.repeat(np.arange(len(rows)), sizes)


def counts(decided: DataFrame) -> np.ndarray:
    """4-gram counts, class x fold x code, of all rule-decided URLs."""
    cells = ALPHABET ** (ORDER + 1)

    def run(batches):
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in tx.slices(batches, "url"):
            code, of = symbols(tx.byte_texts(batch.column(0)))
            group = np.array(batch.column(1).to_pylist(), np.int64)
            k, n = np.unique(group[of] * cells + code, return_counts=True)
            keys, back = np.unique(np.concatenate((keys, k)), return_inverse=True)
            sums = np.bincount(back, np.concatenate((sums, n))).astype(np.int64)
        yield pa.record_batch([pa.array(keys), pa.array(sums)], names=["cell", "n"])

    group = F.when(F.col("decided") == "allow", 0).otherwise(FOLDS) + F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    found = decided.select("url", group.cast("long").alias("g")).mapInArrow(run, "cell long, n long")
    table = np.zeros(2 * FOLDS * cells, np.float32)
    for batch in found.groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_batches():
        table[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return table.reshape(2, FOLDS, cells)


def log_probabilities(table: np.ndarray) -> np.ndarray:
    """Witten-Bell interpolated log-probability of each 4-gram's last symbol, by code."""
    p = np.full((1, ALPHABET), 1 / ALPHABET, np.float32)
    for order in range(ORDER + 1):
        n = table.reshape(-1, ALPHABET**order, ALPHABET).sum(0)
        total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
        lower = np.tile(p, (len(n) // len(p), 1))  # contexts without their oldest symbol
        p = np.where(total > 0, (n + kinds * lower) / np.maximum(total + kinds, 1), lower).astype(np.float32)
    return np.log(p).ravel()


def ratio(accepted: np.ndarray, rejected: np.ndarray) -> np.ndarray:
    return log_probabilities(accepted) - log_probabilities(rejected)


def scores(urls: list[bytes | None], table: np.ndarray) -> np.ndarray:
    """Length-normalised log-likelihood differences; higher is likelier accepted."""
    code, of = symbols(urls)
    n = np.bincount(of, minlength=len(urls))
    return np.bincount(of, table[code], len(urls)) / np.maximum(n, 1)


def threshold(decided: DataFrame, table: np.ndarray) -> float:
    """Where, over the calibration fold, as large a share of allowed URLs lies below as of blocked above."""
    shared = decided.sparkSession.sparkContext.broadcast(table)
    edges = np.linspace(-4, 4, 801)

    def run(batches):
        found = np.zeros((2, len(edges) + 1), np.int64)
        for batch in tx.slices(batches, "url"):
            bins = np.searchsorted(edges, scores(tx.byte_texts(batch.column(0)), shared.value))
            allow = np.array(batch.column(1).to_pylist(), np.int64)
            np.add.at(found, (allow, bins), 1)
        yield pa.record_batch([pa.array(np.repeat([0, 1], len(edges) + 1)), pa.array(np.tile(np.arange(len(edges) + 1), 2)), pa.array(found.ravel())], names=["allow", "bin", "n"])

    held = decided.where(F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == FOLDS - 1).select("url", (F.col("decided") == "allow").cast("long").alias("allow"))
    hist = np.zeros((2, len(edges) + 1))
    for r in held.mapInArrow(run, "allow long, bin long, n long").groupBy("allow", "bin").agg(F.sum("n").alias("n")).collect():
        hist[r.allow, r.bin] = r.n
    if not hist.sum(1).all():
        return 0.0
    below = np.cumsum(hist[1]) / hist[1].sum()
    above = 1 - np.cumsum(hist[0]) / hist[0].sum()
    return float(edges[min(int(np.argmin(np.abs(below - above))), len(edges) - 1)])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (null where a rule decides) of every page."""
    rows = ruled(pages, rules)
    decided = rows.where("decided is not null")
    table = counts(decided)
    seen = table.sum((1, 2))
    if seen.all():
        model = ratio(table[0].sum(0), table[1].sum(0))
        limit = threshold(decided, ratio(table[0, : FOLDS - 1].sum(0), table[1, : FOLDS - 1].sum(0)))
    else:
        model, limit = np.zeros(ALPHABET ** (ORDER + 1), np.float32), 0.0
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def task():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names = ["page_id", "host", "path", "rule", "verdict", "score"]
            by_rule = batch.column(5).to_pylist()
            found = scores(tx.byte_texts(batch.column(1)), shared.value).tolist()
            verdicts = [v or ("allow" if s >= limit else "block") for v, s in zip(by_rule, found)]
            own = [None if v else s for v, s in zip(by_rule, found)]
            return pa.record_batch([batch.column(0), *batch.columns[2:5], pa.array(verdicts, pa.string()), pa.array(own, pa.float64())], names=names)

        return step

    return tx.map_slices(rows, "url", task, "page_id long, host string, path string, rule string, verdict string, score double")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: host, path, rule and verdict of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
