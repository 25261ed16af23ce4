"""Benchmark decontamination with one Aho-Corasick automaton.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A
window is 13 consecutive words of a benchmark item, or all words of a shorter
item. The automaton holds every window as " w1 ... wn "; each document is
normalised to the same form and scanned once. A hit's end offset is mapped back
to word numbers, and from there to offsets in the original text.

Defined cases: a null or empty text has no words and is never contaminated; an
item without words (or null) has no window; an item without an id has hits but no name;
equal windows of several items all count; repeated rows each get their own result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx

#: Benchmark text per automaton. A larger benchmark is scanned in several rounds.
SHARD_BYTES = 8 << 20

_SCAN = "doc_id long, n_words long, hit array<int>, items array<string>"


def item_windows(text: bytes | None, width: int) -> set[bytes]:
    words = (text or b"").translate(tx.FOLD_WORDS).split()
    if not words:
        return set()
    last = max(0, len(words) - width)
    return {b" %b " % b" ".join(words[i : i + width]) for i in range(last + 1)}


def automaton(items: list[tuple[str | None, bytes | None]], width: int) -> ahocorasick.Automaton:
    """Windows with their sizes and items; one of items without an id has hits, but no items."""
    owners: dict[bytes, set[str | None]] = defaultdict(set)
    for item, text in items:
        for window in item_windows(text, width):
            owners[window].add(item)
    found = ahocorasick.Automaton()
    for window, names in owners.items():
        found.add_word(window.decode("latin-1"), (window.count(b" ") - 1, tuple(sorted(n for n in names if n is not None))))
    if len(found):
        found.make_automaton()
    return found


def hits(machine: ahocorasick.Automaton, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """A flag for each word inside an occurring window, and the items of these windows."""
    line = b" %b " % b" ".join(words)
    found = list(machine.iter(line.decode("latin-1"))) if len(machine) and words else []
    if not found:
        return np.zeros(0, bool), set()
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    ends = np.searchsorted(spaces, [end for end, _ in found])
    begins = ends - [size for _, (size, _) in found]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, begins, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0, {name for _, (_, names) in found for name in names}


def original_spans(text: str, flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of hit words as code-point offsets in the original text, end exclusive."""
    data = text.encode()
    is_word = np.frombuffer(data.translate(tx.FOLD_WORDS), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    point = lambda byte: len(data[:byte].decode())
    return [(point(begins[a]), point(ends[b - 1])) for a, b in zip(runs[::2], runs[1::2])]


def shards(benchmark: DataFrame) -> Iterator[list[tuple[str, bytes | None]]]:
    """Benchmark items as lists of at most SHARD_BYTES of text, or of one longer item."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    for row in rows.toLocalIterator():
        data = (row.t or "").encode()
        if held and size + len(data) > SHARD_BYTES:
            yield held
            held, size = [], 0
        held.append((row.i, data))
        size += len(data)
    yield held


def _scanner(items: list, width: int, last: bool) -> Callable:
    """A task that adds the hits of `items` to those that its rows already hold."""

    def task():
        machine = automaton(items, width)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, flags, names = [], [], []
            for text, before, held in zip(tx.byte_texts(batch.column(1)), batch.column(3), batch.column(4)):
                words = (text or b"").translate(tx.FOLD_WORDS).split()
                hit, found = hits(machine, words)
                counts.append(len(words))
                flags.append(np.union1d(np.flatnonzero(hit), before.as_py()).astype(np.int32))
                names.append(sorted(found.union(held.as_py())))
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(flags, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))]
            at = ["doc_id", "n_words", "hit", "items"]
            if not last:
                out.insert(1, batch.column(1))
                at.insert(1, "text")
            return pa.record_batch(out, names=at)

        return step

    return task


def scan(docs: DataFrame, benchmark: DataFrame, width: int = 13) -> DataFrame:
    """doc_id, n_words, the numbers of hit words and the occurring items of every document.

    A benchmark of several shards is scanned by as many mapInArrow steps in a
    row, which carry the hits along; there is no join, so repeated rows stay apart.
    """
    parts = list(shards(benchmark))
    empty = F.array()
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
        empty.cast("array<int>").alias("hit"), empty.cast("array<string>").alias("items"),
    )
    for i, items in enumerate(parts):
        last = i == len(parts) - 1
        out = tx.map_slices(out, "text", _scanner(items, width, last), _SCAN if last else _SCAN.replace("doc_id long,", "doc_id long, text string,"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """One row per document with its counts and whether `share` * n_hit >= n_words > 0."""
    found = scan(docs, benchmark, width)
    n_hit = F.size("hit").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def _judge(items: list, width: int, share: int, last: bool) -> Callable:
    """A task that adds the hits of `items` to __hit; the last one judges them and drops it."""

    def task():
        machine = automaton(items, width)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            flags, keep = [], []
            texts, held = (batch.column(batch.schema.get_field_index(c)) for c in ("text", "__hit"))
            for text, before in zip(tx.byte_texts(texts), held):
                words = (text or b"").translate(tx.FOLD_WORDS).split()
                flags.append(np.union1d(np.flatnonzero(hits(machine, words)[0]), before.as_py()).astype(np.int32))
                keep.append(not (len(flags[-1]) and len(flags[-1]) * share >= len(words)))
            names = [c for c in batch.schema.names if c != "__hit"]
            own = [batch.column(batch.schema.get_field_index(c)) for c in names]
            if last:
                return pa.record_batch(own, names=names).filter(pa.array(keep, pa.bool_()))
            return pa.record_batch([*own, pa.array(flags, pa.list_(pa.int32()))], names=[*names, "__hit"])

        return step

    return task


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """The rows of `docs` that aren't contaminated, with all their columns.

    The hits of all shards are carried along, and the share is judged once on their union.
    """
    parts = list(shards(benchmark))
    held = T.StructField("__hit", T.ArrayType(T.IntegerType()))
    out = docs.withColumn("__hit", F.array().cast("array<int>"))
    for i, items in enumerate(parts):
        last = i == len(parts) - 1
        schema = T.StructType(docs.schema.fields if last else [*docs.schema.fields, held])
        out = tx.map_slices(out, "text", _judge(items, width, share, last), schema)
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document against every benchmark item."""
    return decontaminate(tx.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: DuckDB: windows as word lists, matched by a hash join on 13-word windows of documents.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
dg AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, sizes WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, i, dg.k AS k FROM dg JOIN win ON dg.k = win.k AND dg.g = win.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
