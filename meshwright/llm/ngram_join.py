"""Near duplicates by an exact Jaccard join on word n-grams with vertical partitioning.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; a document's set holds its
distinct 5-word shingles as 64-bit hashes. Two documents link when
100 * |intersection| >= 75 * |union|.

The n-grams have one global order: those outside a bounded list of frequent ones
first, by hash, then the frequent ones by rising frequency. Any such order gives the
right links; frequent n-grams at its end keep shared passages out of the prefixes.

1. Equal sets become one node (their count is the copies). Tasks also report n-grams
   that repeat among their own nodes; the FREQUENT most frequent of these sums are the
   list of the order's end.
2. The order's first fragment, each node's prefix, is joined: linked nodes share an
   n-gram there. A bucket (the nodes that share one) first pairs the node that shares
   most of its prefix with the others. Sizes, places and the overlap within the prefixes
   bound a pair's whole overlap, which rules out most pairs.
3. For the pairs left, the order is cut into FRAGMENTS, the listed n-grams being the last one;
   partial overlaps are counted in each fragment separately and summed per pair, and the
   sum decides the link.
4. Components of these links are found; buckets that still hold several components
   then pair all nodes of different components, so no link between components is
   missed, and step 3 decides on them. Pairs within a component needn't be made. Nodes
   whose size and place let no link start with any size and place of their bucket leave
   it first: a template with another ending in each text makes no pairs.

Defined cases: without words or text a set is empty and the document is its own
component; fewer than 5 words give one n-gram of all words; rows with a null doc_id
take no part and get a null component; repeated rows each get a row.
Two different sets or n-grams are taken for equal if their 64-bit hashes are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwright.sources.store import Scratch, written

from . import text as tx
from .shared import components, cut

SIZE, PERCENT = 5, 75
#: The list of frequent n-grams is bounded; a task reports n-grams of so many own nodes.
FREQUENT, REPEATED = 100_000, 3
FRAGMENTS = 8
#: A task sums up repeated n-grams whenever it holds so many.
HELD = 4_000_000
#: Overlaps are counted in up to so many rounds of fragments, one for each ROUND pairs; a round's shuffle goes before the next.
ROUNDS, ROUND = 4, 25_000
#: Words whose hashes a Python worker keeps; it lives on through the later stages of a pipeline.
WORDS = 100_000


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= WORDS:
            self.clear()
        self[word] = value
        return value


_HASHES = WordHash()
#: An empty list of the order's end.
_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], size: int = SIZE) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    rows = [(t or b"").translate(tx.FOLD_CASE).split() for t in texts]
    hashes = np.fromiter((_HASHES[w] for row in rows for w in row), np.uint64, sum(map(len, rows)))
    grams = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for i in range(size):
        grams = grams * _MIX[0] + hashes[i : i + len(grams)]
    grams = _mixed(grams + np.uint64(size))
    out, at = [], 0
    for row in rows:
        n = len(row)
        if n >= size:
            out.append(np.unique(grams[at : at + n - size + 1]))
        elif n:
            whole = np.zeros(1, np.uint64)
            for h in hashes[at : at + n]:
                whole = whole * _MIX[0] + h
            out.append(_mixed(whole + np.uint64(n)))
        else:
            out.append(grams[:0])
        at += n
    return out


def node_of(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), seed=len(grams)) - (1 << 63)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def prefix_size(n: Column | np.ndarray, percent: int) -> Column | int:
    """n - ceil(percent * n / 100) + 1."""
    return n - (n * percent + 99) // 100 + 1


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def survey(docs: DataFrame, size: int) -> DataFrame:
    """Rows (kind 0: doc_id, set size, node) and (kind 1: n-gram, nodes of this task that hold it, null)."""

    def run(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        count = 0

        def repeated() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= REPEATED
            kind = pa.array(np.ones(int(some.sum()), np.int8))
            return pa.record_batch([kind, _signed(grams[some]), pa.array(n[some]), pa.nulls(len(kind), pa.int64())], names=["kind", "a", "b", "c"])

        for batch in tx.slices(batches, "text"):
            sets = shingle_sets(tx.byte_texts(batch.column(1)), size)
            nodes = [node_of(s) for s in sets]
            sizes = [len(s) for s in sets]
            yield pa.record_batch([pa.array(np.zeros(len(sets), np.int8)), batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], names=["kind", "a", "b", "c"])
            for grams, node in zip(sets, nodes):
                if node not in seen:
                    seen.add(node)
                    held.append(grams)
                    count += len(grams)
            if count > HELD:
                yield repeated()
                held, count = [], 0
                seen.clear()
        if held:
            yield repeated()

    return _rows(docs).mapInArrow(run, "kind byte, a long, b long, c long")


def frequent(reports: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The list of the order's end: hashes ascending, and the rank of each by frequency."""
    sums = reports.where("kind = 1").groupBy("a").agg(F.sum("b").alias("n"))
    top = sums.orderBy(F.desc("n"), "a").limit(FREQUENT).toArrow()
    grams = top["a"].to_numpy().view(np.uint64)
    rank = np.arange(len(grams), 0, -1)
    order = np.argsort(grams)
    return grams[order], rank[order]


def ranks(grams: np.ndarray, listed: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """0 for n-grams that aren't listed, else their rank."""
    if not len(listed):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(listed, grams), len(listed) - 1)
    return np.where(listed[at] == grams, rank[at], 0)


def prefixes(docs: DataFrame, end: tuple[np.ndarray, np.ndarray], size: int, percent: int) -> DataFrame:
    """gram, node, n, at: each node's first n-grams in the global order, once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(end)

    def run(batches):
        listed, rank = shared.value
        seen: set[int] = set()
        for batch in tx.slices(batches, "text"):
            grams, nodes, sizes = [], [], []
            for s in shingle_sets(tx.byte_texts(batch.column(1)), size):
                n, node = len(s), node_of(s)
                if not n or node in seen:
                    continue
                seen.add(node)
                grams.append(s[np.argsort(ranks(s, listed, rank), kind="stable")[: prefix_size(n, percent)]])
                nodes.append(node)
                sizes.append(n)
            if grams:
                m = [len(g) for g in grams]
                yield pa.record_batch([_signed(np.concatenate(grams)), pa.array(np.repeat(nodes, m)), pa.array(np.repeat(sizes, m).astype(np.int32)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in m]))], names=["gram", "node", "n", "at"])

    return _rows(docs).where("doc_id is not null").mapInArrow(run, "gram long, node long, n int, at int")


def _needed(percent: int) -> Column:
    """The least overlap of a link: ceil(percent * (na + nb) / (100 + percent))."""
    return F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))


def _may(percent: int, na: Column, left_a: Column, nb: Column, left_b: Column) -> Column:
    """Sizes and places allow a link whose first shared n-gram this is.

    Behind a first shared n-gram at most the lesser number of shared ones left in the prefixes, and what
    follows the prefix, can be shared.
    """
    sizes = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    behind = F.least(left_a, left_b) + F.ceil(F.greatest(na, nb) * percent / 100) - 1
    return sizes & (behind >= F.ceil((na + nb) * percent / (100 + percent)))


def _may_start(percent: int) -> Column:
    """`h` is how many n-grams of a node's prefix other nodes share, `i` how many of these stand before."""
    return _may(percent, F.col("na"), F.col("ha") - F.col("ia"), F.col("nb"), F.col("hb") - F.col("ib"))


def plausible(pairs: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose overlap within the prefixes lets them reach the needed overlap.

    N-grams up to the end of the prefix that ends first are in both prefixes; behind
    it at most the rest of that set can be shared.
    """
    # a node's part of the buckets is at most its own prefix
    held = buckets.groupBy("node").agg(F.collect_set("gram").alias("grams"))
    x = held.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    y = held.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    both = pairs.join(x, "a").join(y, "b")
    rest = F.greatest("na", "nb") * percent / 100
    return both.where(F.size(F.array_intersect("ga", "gb")) + F.ceil(rest) - 1 >= _needed(percent)).select("a", "na", "b", "nb")


def fragments_of(grams: np.ndarray, end: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """A set cut along the global order: equal stretches of its unlisted n-grams by hash, then the listed ones."""
    listed = ranks(grams, *end) > 0
    first = grams[~listed]
    bounds = [np.uint64(i * (2**64 // (FRAGMENTS - 1))) for i in range(1, FRAGMENTS - 1)]
    return [*np.split(first, np.searchsorted(first, bounds)), grams[listed]]


def overlaps(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, end: tuple[np.ndarray, np.ndarray] = _NONE) -> DataFrame:
    """a, na, b, nb and the overlap of each pair: partial overlaps by fragment of the global order, summed."""
    shared = docs.sparkSession.sparkContext.broadcast(end)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    owners = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node").select("doc_id", F.col("node").alias("want"))
    texts = _rows(docs).join(owners, "doc_id").select("want", "text")

    def run(batches):
        for batch in tx.slices(batches, "text"):
            nodes_, parts, grams = [], [], []
            for want, s in zip(batch.column(0).to_pylist(), shingle_sets(tx.byte_texts(batch.column(1)), size)):
                if node_of(s) != want:
                    continue  # another row with this doc_id
                for i, part in enumerate(fragments_of(s, shared.value)):
                    if len(part):
                        nodes_.append(want)
                        parts.append(i)
                        grams.append(part.view(np.int64))
            yield pa.record_batch([pa.array(nodes_, pa.int64()), pa.array(parts, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["node", "part", "grams"])

    scratch = Scratch(docs.sparkSession)
    fragments = scratch.written(texts.mapInArrow(run, "node long, part int, grams array<long>"), "fragments")
    rounds = max(1, min(ROUNDS, pairs.count() // ROUND))
    partial = []
    for k in range(rounds):
        # a row that stands several times gives its fragments as often; each may count once
        own = fragments.where(F.pmod("part", F.lit(rounds)) == k).repartition("node").dropDuplicates(["node", "part"])
        x = own.select(F.col("node").alias("a"), "part", F.col("grams").alias("ga"))
        y = own.select(F.col("node").alias("b"), "part", F.col("grams").alias("gb"))
        met = pairs.join(x, "a").join(y, ["b", "part"]).select("a", "na", "b", "nb", F.size(F.array_intersect("ga", "gb")).alias("k"))
        partial.append(scratch.written(met.groupBy("a", "na", "b", "nb").agg(F.sum("k").alias("k")), "partial"))
    counted = written(reduce(DataFrame.unionByName, partial).groupBy("a", "na", "b", "nb").agg(F.sum("k").alias("overlap")), "overlaps")
    scratch.drop([fragments, *partial])
    return counted


def _linked(counted: DataFrame, percent: int) -> DataFrame:
    return counted.where(F.col("overlap") * 100 >= (F.col("na") + F.col("nb") - F.col("overlap")) * percent)


def links(docs: DataFrame, nodes: DataFrame, end: tuple, size: int, percent: int) -> DataFrame:
    """a, na, b, nb, overlap: enough links to connect every component."""
    by_gram, by_node = Window.partitionBy("gram"), Window.partitionBy("node")
    found = prefixes(docs, end, size, percent).withColumns({"low": F.min("node").over(by_gram), "high": F.max("node").over(by_gram)})
    buckets = found.where("low <> high").select("gram", "node", "n", "at").distinct()
    buckets = cut(buckets.withColumns({"h": F.count(F.lit(1)).over(by_node), "i": F.row_number().over(by_node.orderBy("at")) - 1}).drop("at"))
    side = lambda x: buckets.select("gram", F.col("node").alias(x), *(F.col(c).alias(c + x) for c in ("n", "h", "i")))
    # the node that shares most of its prefix is likeliest the centre of its near copies
    lead = buckets.groupBy("gram").agg(F.max(F.struct("h", "node", "n", "i")).alias("p"))
    lead = lead.select("gram", F.col("p.node").alias("a"), *(F.col(f"p.{c}").alias(c + "a") for c in ("n", "h", "i")))
    pairs = side("b").join(lead, "gram").where("a <> b").where(_may_start(percent)).select("a", "na", "b", "nb").distinct()
    pairs = cut(plausible(pairs, buckets, percent))
    first = cut(_linked(overlaps(docs, nodes, pairs, size, end), percent))
    roots = components(first.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # nodes of one size and place are a kind; a node whose kind may be linked to none of its bucket's has no partner there
    left = (F.col("h") - F.col("i")).alias("left")
    bucket = {"low": F.min("root").over(by_gram), "high": F.max("root").over(by_gram), "kinds": F.collect_set(F.struct("n", left)).over(by_gram)}
    mixed = placed.withColumns(bucket).where("low <> high").where(F.exists("kinds", lambda k: _may(percent, F.col("n"), F.col("h") - F.col("i"), k.n, k.left)))
    mixed = cut(mixed.select("gram", "node", "n", "h", "i", "root"))
    across = _across(mixed, percent)
    # a pair of step 2 may come in either order
    done = pairs.select("a", "b").union(pairs.select("b", "a"))
    across = cut(plausible(across.join(done, ["a", "b"], "left_anti"), buckets, percent))
    second = _linked(overlaps(docs, nodes, across, size, end), percent)
    return cut(first.unionByName(second))


def _one(rows: DataFrame, x: str) -> DataFrame:
    return rows.select("gram", F.col("node").alias(x), *(F.col(c).alias(c + x) for c in ("n", "h", "i")), F.col("root").alias("r" + x))


def _across(mixed: DataFrame, percent: int) -> DataFrame:
    """a, na, b, nb: nodes of a bucket in different components that may be linked."""
    return _one(mixed, "a").join(_one(mixed, "b"), "gram").where("ra < rb").where(_may_start(percent)).select("a", "na", "b", "nb").distinct()


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    reports = cut(survey(docs, size))
    own = reports.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("node"))
    nodes = own.where("doc_id is not null and n_shingles > 0")
    found = links(docs, nodes, frequent(reports), size, percent)
    roots = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    # copies are counted per node first, so a node with many is one row from here on
    least = nodes.groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = least.groupBy("root").agg(F.min("low").alias("component_id"))
    by_node = least.join(names, "root").select("node", "component_id")
    out = own.join(by_node, "node", "left")
    own_name = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own_name).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` but those whose component holds a document with a smaller id."""
    extra = near_duplicates(docs, size, percent).where("component_id < doc_id").select(F.col("doc_id").alias("__extra")).distinct()
    return docs.join(extra, docs["doc_id"].cast("long") == extra["__extra"], "left_anti")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the component of every document."""
    return near_duplicates(tx.documents(spark, sf_dir))
