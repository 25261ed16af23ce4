"""Exact top-k inner products over integer vectors by a three-phase uniform threshold.

A vector's dimensions are cut into `lists` runs. Each run is a list of its own: the score
of a pair there is the product over those dimensions, and a pair's score is the sum over
the lists. No task sees more than one list of one block of rows and of queries.

1. Every list gives each query its k best local scores. The candidates so found are
   resolved, and the k-th best of their scores, `tau`, is a safe cutoff: the answer is at
   least that good.
2. `tau` goes to the tasks with the queries. A pair of score `tau` or more has a local
   score of at least tau / lists somewhere, so every list gives all its entries from there on.
3. Entries are added up by pair. What a list didn't give is below the cutoff, which bounds
   the pair's score; pairs that may still reach `tau` are looked up in the lists they miss.

Rows of equal vectors are one class, which stands for its k + 1 smallest ids (one may be the
query's own), so a vector that a third of the rows share costs as much as any other. Blocks
are dealt by a hash; a task holds ROWS classes and QUERIES queries of one list at most.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor
do rows without a vec_id, nor vectors whose scaled components have squares that sum to 2^62 or
more (their products may not fit a long). Vectors of another length than a query's aren't its
candidates; empty vectors have products of 0. Repeated rows count once; an id that stands with
several vectors is asked once for each, and none of its rows answers itself. Other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: Lists that a vector is cut into: the fewer, the higher the cutoff in each.
LISTS = 2
ROWS, QUERIES = 8192, 2048
#: Queries whose products with a block stand in memory at once.
_AT_ONCE = 128
_KEYS = ["d", "list", "rb", "qb"]
_ENTRY = "qk long, cid long, list int, local long"


def scaled(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component, without rows that take no part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")) < float(1 << 62)
    taken = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)
    return taken.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v")).where(small).distinct()


def _classes(known: DataFrame, k: int) -> DataFrame:
    """cid, v, its k + 1 smallest ids, and `own`: the id of a class of one."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = known.withColumn("rn", rank).where(F.col("rn") <= k + 1)
    made = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    own = F.when(F.size("ids") == 1, F.get("ids", F.lit(0)))
    return shared.written(made.select(F.monotonically_increasing_id().alias("cid"), "v", "ids", own.alias("own")), "classes")


class _Lists:
    """The blocks of classes and queries, list by list, and jobs over them."""

    def __init__(self, classes: DataFrame, queries: DataFrame, lists: int):
        self.lists = lists
        self.row_blocks = max(1, math.ceil(classes.count() / ROWS))
        self.query_blocks = max(1, math.ceil(queries.count() / QUERIES))
        self.classes, self.queries = classes, queries

    def _block(self, key: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")

    def _keys(self, v: Column) -> Column:
        """One entry a list: its number and the components in it."""
        d = F.size(v)
        edge = lambda i: F.floor(d * i / self.lists).cast("int")
        part = lambda i: F.struct(F.lit(i).alias("list"), F.slice(v, edge(i) + 1, edge(i + 1) - edge(i)).alias("part"))
        return F.explode(F.array(*(part(i) for i in range(self.lists))))

    def _blocks(self, cuts: DataFrame | None) -> DataFrame:
        none = F.lit(None).cast("long")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        rows = self.classes.select(F.lit(False).alias("asks"), F.col("cid").alias("key"), F.col("own").alias("id"), none.alias("tau"), "v")
        rows = rows.select("*", self._block("key", self.row_blocks).alias("rb"), every(self.query_blocks).alias("qb"))
        asked = self.queries.select("qk", F.col("vec_id").alias("id"), "v")
        asked = asked.withColumn("tau", none) if cuts is None else asked.join(cuts, "qk", "left")
        asked = asked.select(F.lit(True).alias("asks"), F.col("qk").alias("key"), "id", "tau", "v")
        asked = asked.select("*", self._block("key", self.query_blocks).alias("qb"), every(self.row_blocks).alias("rb"))
        both = rows.unionByName(asked).withColumn("d", F.size("v"))
        return both.select("*", self._keys(F.col("v")).alias("x")).select("asks", "key", "id", "tau", "d", "rb", "qb", "x.list", "x.part")

    def entries(self, choose: Callable, cuts: DataFrame | None = None) -> DataFrame:
        """What `choose` takes of the local scores, (qk, cid, list, local)."""
        lists = self.lists
        return self._blocks(cuts).groupBy(*_KEYS).applyInArrow(lambda t: _local(t, choose, lists), _ENTRY)

    def resolved(self, wanted: DataFrame) -> DataFrame:
        """The local scores of the wanted (qk, cid, list)."""
        d = self.queries.select("qk", F.size("v").alias("d"))
        asked = wanted.join(d, "qk").withColumns({"rb": self._block("cid", self.row_blocks), "qb": self._block("qk", self.query_blocks)})
        return self._blocks(None).groupBy(*_KEYS).cogroup(asked.groupBy(*_KEYS)).applyInArrow(_looked_up, _ENTRY)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0, np.int64)])
    return flat.astype(np.int64).reshape(len(column), len(flat) // max(1, len(column)))


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """Doubles where no sum of products can reach 2^53, else 64-bit integers."""
    longest = lambda m: math.sqrt(float((m.astype(np.float64) ** 2).sum(1).max(initial=0)))
    return np.float64 if longest(a) * longest(b) < 1 << 52 else np.int64


def _split(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    asks = table["asks"]
    return table.filter(pc.invert(asks)), table.filter(asks)


def _table(parts: list[tuple]) -> pa.Table:
    columns = zip(*parts) if parts else ([], [], [], [])
    q, c, n, s = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in columns)
    return pa.table({"qk": q, "cid": c, "list": n.astype(np.int32), "local": s})


def _local(table: pa.Table, choose: Callable, lists: int) -> pa.Table:
    rows, queries = _split(table)
    out = []
    if rows.num_rows and queries.num_rows:
        rows = rows.sort_by([("id", "ascending")])  # nulls last
        cid, own = rows["key"].to_numpy(), rows["id"].drop_null().to_numpy()
        x, q = _matrix(rows["part"]), _matrix(queries["part"])
        kind = _exact(x, q)
        x, least = np.ascontiguousarray(x.T.astype(kind)), np.iinfo(np.int64).min
        qk, ids = queries["key"].to_numpy(), queries["id"].to_numpy()
        tau = queries["tau"].fill_null(-(1 << 62)).to_numpy()
        begin, end = np.searchsorted(own, ids), np.searchsorted(own, ids, "right")
        number = table["list"][0].as_py()
        for at in range(0, len(q), _AT_ONCE):
            some = slice(at, at + _AT_ONCE)
            score = q[some].astype(kind) @ x
            for i, (b, e) in enumerate(zip(begin[some], end[some])):
                score[i, b:e] = least  # a query's own row
            i, j = choose(score, tau[some], lists)
            took = score[i, j]
            i, j, took = i[took > least], j[took > least], took[took > least]
            out.append((qk[some][i], cid[j], np.full(len(i), number), took.astype(np.int64)))
    return _table(out)


def _best(k: int) -> Callable:
    """Phase 1: the k best of each query."""

    def choose(score: np.ndarray, tau: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
        n = min(k, score.shape[1])
        top = np.argpartition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n :]
        return np.repeat(np.arange(len(score)), n), top.ravel()

    return choose


def _above(score: np.ndarray, tau: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Phase 2: everything from the cutoff on."""
    return np.nonzero(score >= cutoff(tau, lists)[:, None])


def cutoff(tau: np.ndarray, lists: int) -> np.ndarray:
    """The least whole local score that a pair of `tau` must have in some list."""
    return -((-tau) // lists)


def _looked_up(table: pa.Table, wanted: pa.Table) -> pa.Table:
    if not wanted.num_rows:
        return _table([])
    rows, queries = (t.sort_by([("key", "ascending")]) for t in _split(table))
    x, q = _matrix(rows["part"]), _matrix(queries["part"])
    qk, cid, number = (wanted[c].to_numpy() for c in ("qk", "cid", "list"))
    i, j = np.searchsorted(queries["key"].to_numpy(), qk), np.searchsorted(rows["key"].to_numpy(), cid)
    out = []
    for at in range(0, len(i), 1 << 16):
        some = slice(at, at + (1 << 16))
        out.append((qk[some], cid[some], number[some], np.einsum("nd,nd->n", q[i[some]], x[j[some]])))
    return _table(out)


def search(rows: DataFrame, is_query: Column, k: int = 5, lists: int = LISTS, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest products of each row for which `is_query` holds."""
    known = scaled(rows, scale)
    classes = _classes(known, k)
    queries = shared.written(known.where(is_query).select(F.monotonically_increasing_id().alias("qk"), "vec_id", "v"), "queries")
    held = _Lists(classes, queries, lists)

    # phase 1
    by_list = Window.partitionBy("qk", "list").orderBy(F.desc("local"), "cid")
    first = held.entries(_best(k)).withColumn("rn", F.row_number().over(by_list)).where(F.col("rn") <= k).select("qk", "cid").distinct()
    every = first.select("qk", "cid", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"))
    found = held.resolved(every).groupBy("qk", "cid").agg(F.sum("local").alias("score"))
    kth = F.row_number().over(Window.partitionBy("qk").orderBy(F.desc("score"), "cid"))
    cuts = shared.written(found.withColumn("rn", kth).where(F.col("rn") == k).select("qk", F.col("score").alias("tau")), "cuts")

    # phase 2; queries with fewer candidates than k have no cutoff and get all entries
    gathered = held.entries(_above, cuts).groupBy("qk", "cid").agg(F.sum("local").alias("seen"), F.collect_set("list").alias("seen_in"))
    gathered = gathered.join(cuts, "qk", "left")
    below = F.ceil(F.col("tau").cast("decimal(38,0)") / lists).cast("long") - 1
    most = F.col("seen") + (lists - F.size("seen_in")) * below
    gathered = shared.written(gathered.where(F.col("tau").isNull() | (most >= F.col("tau"))).select("qk", "cid", "seen", "seen_in", "tau"), "gathered")

    # phase 3
    every = F.array(*(F.lit(i) for i in range(lists)))
    missing = gathered.select("qk", "cid", F.explode(F.array_except(every, "seen_in")).alias("list"))
    parts = gathered.select("qk", "cid", F.col("seen").alias("local")).unionByName(held.resolved(missing).select("qk", "cid", "local"))
    scores = parts.groupBy("qk", "cid").agg(F.sum("local").alias("score")).join(cuts, "qk", "left").where("tau is null or score >= tau")
    answers = scores.join(classes.select("cid", "ids"), "cid").join(queries.select("qk", F.col("vec_id").alias("query_id")), "qk")
    answers = answers.select("qk", "query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("qk").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: rows whose vec_id is divisible by 50, against all rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_dot_product(q.e, r.e) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, r.e) DESC, r.vec_id) AS rank
  FROM v q JOIN v r ON q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id) WHERE rank <= 5
"""
