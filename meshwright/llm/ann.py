"""Nearest neighbours by inner product with score-aware quantisation.

Vectors are split into subspaces of a few dimensions with 16 centres each (four-bit
codes, two to a byte). Centres and codes minimise the anisotropic loss

    |x - q|^2 + (eta - 1) * ((x - q) . x / |x|)^2,

which weighs the error along the vector, the part that changes large inner products,
eta times as much. A query adds up table entries over a block's codes (a 256-entry
table per byte), keeps the RERANK best of a block, and reranks them exactly in double
precision on the original vectors.

Rows and queries are dealt to blocks by a hash of their id; a task holds one block
of rows (about ROWS) and one of queries (about QUERIES). Equal vectors of a block are
scanned once and stand for their smallest ids, so ties and heavy repetition lose
nothing. A block gives each query its k best, and a window over a query's blocks ranks
those.

The codebook is fitted on at most FIT_ROWS rows chosen by a hash of their id; every row
is indexed. Defined cases: vectors that are null, zero, or hold a null or non-finite
component take no part; vectors of another dimension than a query's aren't its candidates; a null
vec_id takes no part; of rows with equal ids each is a candidate of other ids' queries; a
query that stands several times with one vector is asked once, with different vectors once each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIT_ROWS = 20_000
ROWS, QUERIES = 16_384, 16_384
RERANK = 400
CENTRES, WIDTH = 16, 2
#: Share of a vector's length beyond which inner products matter; it sets eta.
FOCUS = 0.2
SWEEPS, ROUNDS = 2, 8


def eta(dim: int, focus: float = FOCUS) -> float:
    return max(1.0, (dim - 1) * focus**2 / (1 - focus**2))


class Codebook:
    """Centres (subspace x 16 x width) fitted to sample rows."""

    def __init__(self, sample: np.ndarray, seed: int = 5):
        n, self.dim = sample.shape
        self.width = min(WIDTH, self.dim)
        self.spaces = -(-self.dim // self.width)
        self.spaces += self.spaces % 2  # two codes to a byte
        self.eta = eta(self.dim)
        x, u = self._split(sample)
        start = np.random.default_rng(seed).integers(0, n, (self.spaces, CENTRES))
        self.centres = np.stack([x[start[m], m] for m in range(self.spaces)])
        for _ in range(ROUNDS):
            code = self._assign(x, u)
            self._update(x, u, code)

    def _split(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), self.spaces * self.width))
        x[:, : self.dim] = rows
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        shape = (len(rows), self.spaces, self.width)
        return x.reshape(shape), u.reshape(shape)

    def _assign(self, x: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss."""
        n = len(x)
        code = np.empty((n, self.spaces), np.uint8)
        along = np.zeros(n)  # residual along the vector, over all subspaces
        own = np.zeros((n, self.spaces))
        for sweep in range(SWEEPS + 1):
            for m in range(self.spaces):
                left = x[:, m, None, :] - self.centres[m]
                square = (left**2).sum(2)
                part = np.einsum("nkw,nw->nk", left, u[:, m])
                if sweep:  # the first sweep starts from the nearest centres
                    square += (self.eta - 1) * ((along - own[:, m])[:, None] + part) ** 2
                code[:, m] = best = square.argmin(1)
                fresh = part[np.arange(n), best]
                along += fresh - own[:, m]
                own[:, m] = fresh
        return code

    def _update(self, x: np.ndarray, u: np.ndarray, code: np.ndarray) -> None:
        """Centres that minimise the loss for these codes: a small linear system each."""
        rows = np.arange(len(x))
        part = np.stack([((x[:, m] - self.centres[m][code[:, m]]) * u[:, m]).sum(1) for m in range(self.spaces)], 1)
        along = part.sum(1)
        for m in range(self.spaces):
            for k in range(CENTRES):
                mine = rows[code[:, m] == k]
                if not len(mine):
                    continue
                v, y = u[mine, m], x[mine, m]
                rest = along[mine] - part[mine, m] + (y * v).sum(1)
                left = len(mine) * np.eye(self.width) + (self.eta - 1) * v.T @ v
                self.centres[m, k] = np.linalg.solve(left, y.sum(0) + (self.eta - 1) * v.T @ rest)

    def encode(self, rows: np.ndarray) -> np.ndarray:
        """Two codes to a byte."""
        code = np.concatenate([self._assign(*self._split(rows[i : i + 4096])) for i in range(0, len(rows), 4096)])
        return code[:, ::2] << 4 | code[:, 1::2]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte of a code, the 256 sums of two products with centres."""
        q = np.zeros((len(queries), self.spaces * self.width))
        q[:, : self.dim] = queries
        single = np.einsum("qmw,mkw->qmk", q.reshape(len(q), self.spaces, self.width), self.centres)
        pairs = single[:, ::2, :, None] + single[:, 1::2, None, :]
        return pairs.reshape(len(q), self.spaces // 2, CENTRES * CENTRES).astype(np.float32)


def vectors(rows: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, without rows that take no part."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _best(book: Codebook, rows: pa.Table, queries: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    ids = rows["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], _matrix(rows["v"])[order]
    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
    keys = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, first, group, size = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    members = np.argsort(group, kind="stable")  # rows by distinct vector, ids ascending within
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    bytes_of = np.ascontiguousarray(codes[first].T).astype(np.intp)
    kept = min(len(first), max(RERANK, 4 * k))
    q_ids, q_keys, q = queries["vec_id"].to_numpy(), queries["qkey"].to_numpy(), _matrix(queries["v"])
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(q), 256):
        for q_id, q_key, query, table in zip(q_ids[at : at + 256], q_keys[at : at + 256], q[at : at + 256], book.tables(q[at : at + 256])):
            near = table[0][bytes_of[0]]
            for t, b in zip(table[1:], bytes_of[1:]):
                near += t[b]
            top = np.argpartition(-near, kept - 1)[:kept] if kept < len(near) else np.arange(len(near))
            exact = x[first[top]] @ query
            top, exact = top[np.argsort(-exact, kind="stable")], np.sort(exact)[::-1]
            bound = exact[min(k, len(exact) - 1)]
            use = exact >= bound  # k + 1 distinct vectors, as one may be the query alone
            take = [members[begin[g] : begin[g] + min(size[g], k + 1)] for g in top[use]]
            got = np.concatenate(take)
            score = np.repeat(exact[use], [len(t) for t in take])
            other = ids[got] != q_id
            got, score = ids[got][other], score[other]
            best = np.lexsort((got, -score))[:k]
            out.append((np.full(len(best), q_id), np.full(len(best), q_key), got[best], score[best]))
        if sum(len(o[0]) for o in out) > 100_000:
            yield _found(out)
            out = []
    if out:
        yield _found(out)


def _found(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    a, b, c, d = (np.concatenate(x) for x in zip(*out))
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "qkey", "vec_id", "score"])


def fit(rows: DataFrame, n: int) -> Codebook | None:
    place = F.pmod(F.xxhash64("vec_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(place < min(1.0, FIT_ROWS / n)).select("v").limit(2 * FIT_ROWS).toArrow()
    return Codebook(np.unique(_matrix(sample["v"]), axis=0)) if sample.num_rows else None  # a common vector counts once


def search(rows: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row for which `is_query` holds.

    Vectors of different dimensions have no inner product: each dimension is searched by itself.
    """
    spark = rows.sparkSession
    known = vectors(rows)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for row in known.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():
        out = out.unionByName(_search(known.where(F.size("v") == row.d), row.n, is_query, k))
    return out


def _search(known: DataFrame, n: int, is_query, k: int) -> DataFrame:
    spark = known.sparkSession
    book = fit(known, n)
    if book is None:  # the hash chose none of a few rows
        book = Codebook(np.unique(_matrix(known.select("v").limit(2 * FIT_ROWS).toArrow()["v"]), axis=0))
    shared = spark.sparkContext.broadcast(book)
    row_blocks, query_blocks = math.ceil(n / ROWS), math.ceil(n / QUERIES / 16)

    def encoded(batches):
        for batch in batches:
            if batch.num_rows:
                code = shared.value.encode(_matrix(batch.column(1)))
                yield pa.record_batch([*batch.columns, pa.array([c.tobytes() for c in code], pa.binary())], names=["vec_id", "v", "code"])

    def near(table_rows: pa.Table, table_queries: pa.Table) -> Iterator[pa.RecordBatch]:
        if table_rows.num_rows and table_queries.num_rows:
            yield from _best(shared.value, table_rows, table_queries, k)

    block = lambda salt, m: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = known.mapInArrow(encoded, "vec_id long, v array<double>, code binary").withColumn("rb", block("row", row_blocks)).withColumn("qb", each(query_blocks))
    asked = known.where(is_query).dropDuplicates(["vec_id", "v"]).withColumn("qkey", F.xxhash64("v")).withColumn("qb", block("query", query_blocks)).withColumn("rb", each(row_blocks))
    found = dealt.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInArrow(lambda a, b: _one(near(a, b)), "query_id long, qkey long, vec_id long, score double")
    by_query = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _one(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    schema = pa.schema([("query_id", pa.int64()), ("qkey", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    return pa.Table.from_batches(list(batches), schema)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: rows whose vec_id is divisible by 20, against all rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


#: DuckDB, exact; the query's recall is measured against it.
EXACT = r"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_dot_product(q.e, r.e) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, r.e) DESC, r.vec_id) AS rank
  FROM v q JOIN v r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id) WHERE rank <= 20
"""
