"""Centroid clustering with partial-distance search, in whole numbers.

Every round is one pass: a task scores its batches against the few centroids and gives, for
each centroid, the count and the componentwise sum of its vectors; Spark adds these up and
only centroids x dimensions numbers reach the driver.

Partial distances: dimensions are taken in falling order of their variance (one pass before the
rounds), CHUNK at a time. After the first chunk the nearest centroid by that part is finished
first, for all vectors; another centroid is abandoned for a vector once its part is strictly
above the best whole distance, and what survives all chunks is compared whole. As a
part never exceeds the whole, no nearest centroid is lost, and ties go to the smaller number.

All sums are integers, so results don't depend on how rows are dealt; a task that runs again
gives the same. Defined cases: vectors that are null, have another length, hold null or
non-finite components or scaled components of 2^27 or more in magnitude (their squared
distances may not fit a long) take no part, nor do rows without a vec_id; with fewer than k
vectors each starts a centroid, without any the result is empty; repeated rows count each, and
of rows with one id those of the smaller vector start first. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIM, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
CHUNK = 16
_LIMIT = 1 << 27


def kept(rows: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component, of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * float(scale)) < float(_LIMIT)))
    taken = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & good)
    return taken.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * float(scale))).alias("v"))


def start(points: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors of the smallest hashes of their ids."""
    by = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return np.array([r.v for r in points.orderBy(by, "v").limit(k).collect()], np.int64)


def _batches(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)


def by_variance(points: DataFrame, dim: int = DIM) -> np.ndarray:
    """Dimensions by falling variance; the order changes the work, never the result."""

    def sums(batches):
        n, s, q = 0, np.zeros(dim), np.zeros(dim)
        for _, x in _batches(batches, dim):
            n, s, q = n + len(x), s + x.sum(0), q + (x.astype(float) ** 2).sum(0)
        if n:
            yield pa.record_batch([pa.array([float(n)]), pa.array([s.tolist()]), pa.array([q.tolist()])], names=["n", "s", "q"])

    parts = points.mapInArrow(sums, "n double, s array<double>, q array<double>")
    row = parts.agg(F.sum("n").alias("n"), *(F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in "sq" for i in range(dim))).first()
    s, q = (np.array([row[f"{c}{i}"] for i in range(dim)]) for c in "sq")
    return np.argsort(-(q / row.n - (s / row.n) ** 2), kind="stable")


def nearest(x: np.ndarray, centres: np.ndarray, order: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centroid and squared distance, by partial distances in the dimensions' order."""
    n, k, dim = len(x), len(centres), x.shape[1]
    x, centres = np.ascontiguousarray(x[:, order]), np.ascontiguousarray(centres[:, order])
    rows = np.arange(n)
    part = np.empty((n, k), np.int64)
    for j in range(k):
        part[:, j] = ((x[:, :chunk] - centres[j, :chunk]) ** 2).sum(1)
    guess = part.argmin(1)
    best = part[rows, guess] + ((x[:, chunk:] - centres[guess, chunk:]) ** 2).sum(1)
    cluster = guess.copy()
    alive = part <= best[:, None]
    alive[rows, guess] = False
    i, j = np.nonzero(alive)
    total = part[i, j]
    for at in range(chunk, dim, chunk):
        total = total + ((x[i, at : at + chunk] - centres[j, at : at + chunk]) ** 2).sum(1)
        left = total <= best[i]
        i, j, total = i[left], j[left], total[left]
    closer = np.lexsort((j, total, i))  # the first of each row is its nearest survivor
    i, j, total = i[closer], j[closer], total[closer]
    first = np.ones(len(i), bool)
    first[1:] = i[1:] != i[:-1]
    i, j, total = i[first], j[first], total[first]
    won = (total < best[i]) | ((total == best[i]) & (j < guess[i]))
    cluster[i[won]], best[i[won]] = j[won], total[won]
    return cluster, best


@dataclass
class Clusters:
    """Final centroids, the order of dimensions, and the distances summed by cluster."""

    centres: np.ndarray
    order: np.ndarray
    inertia: list[int]


def _pass(points: DataFrame, centres: np.ndarray, order: np.ndarray) -> list[tuple[int, list[int], int]]:
    """By centroid: its vectors' count, their sums and the sum of their distances."""
    k, dim = centres.shape

    def sums(batches):
        n, total, far = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), [0] * k
        for _, x in _batches(batches, dim):
            cluster, distance = nearest(x, centres, order)
            n += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster):
                total[j] += x[cluster == j].sum(0)
                far[j] += int(distance[cluster == j].astype(object).sum())
        if n.any():
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(some), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64())), pa.array([str(far[j]) for j in some])], names=["j", "n", "s", "far"])

    parts = points.mapInArrow(sums, "j long, n long, s array<long>, far string")
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    added = parts.groupBy("j").agg(F.sum("n").alias("n"), exact(F.col("far")).alias("far"), *(exact(F.col("s")[i]).alias(f"s{i}") for i in range(dim)))
    out = [(0, [0] * dim, 0)] * k
    for r in added.collect():  # at most k rows
        out[r.j] = (r.n, [int(r[f"s{i}"]) for i in range(dim)], int(r.far))
    return out


def fit(points: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> Clusters | None:
    """`rounds` rounds of assigning and moving centroids, which keep their numbers; None without vectors."""
    centres = start(points, k)
    if not len(centres):
        return None
    order = by_variance(points, dim)
    for _ in range(rounds):
        for j, (n, sums, _) in enumerate(_pass(points, centres, order)):
            if n:
                centres[j] = [s // n for s in sums]
    return Clusters(centres, order, [far for _, _, far in _pass(points, centres, order)])


_OUT = "vec_id long, cluster int, distance long, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string, centroid array<long>"


def assign(points: DataFrame, found: Clusters | None) -> DataFrame:
    """Per vector: its cluster, distance, the sums of distances, its centroid and that one's digest."""
    if found is None:
        return points.sparkSession.createDataFrame([], _OUT)
    dim = found.centres.shape[1]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centres.tolist()]
    whole = pa.decimal128(38, 0)
    each, total = pa.array(found.inertia, whole), pa.array([sum(found.inertia)], whole)
    centres = pa.array(found.centres.tolist(), pa.list_(pa.int64()))
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid"]

    def rows(batches):
        for ids, x in _batches(batches, dim):
            cluster, distance = nearest(x, found.centres, found.order)
            yield pa.record_batch([
                ids, pa.array(cluster.astype(np.int32)), pa.array(distance), each.take(pa.array(cluster)),
                total.take(pa.array(np.zeros(len(x), int))), pa.array(digest).take(pa.array(cluster)), centres.take(pa.array(cluster)),
            ], names=names)

    return points.mapInArrow(rows, _OUT)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all embeddings."""
    points = kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = assign(points, fit(points))
    return out.select("vec_id", "cluster", "distance", F.col("cluster_inertia").cast("long").alias("cluster_inertia"), F.col("inertia").cast("long").alias("inertia"), "centroid_sha256")


def _oracle() -> str:
    """The rounds as a chain of common tables; every table is materialised, as each round reads the one before."""
    finite = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {DIM} AND {finite})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster, e FROM v QUALIFY cluster < {CENTROIDS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, e, best.cluster AS cluster, best.d AS distance FROM (SELECT v.vec_id, v.e, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), cluster := c.cluster)) AS best FROM v, c{r} c GROUP BY v.vec_id, v.e))"
        )
        if r < ROUNDS:
            parts.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(n.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT cluster, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS e FROM (SELECT cluster, i, CAST(sum(e[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {DIM + 1}) AS t(i) GROUP BY cluster, i) GROUP BY cluster) n ON n.cluster = c.cluster)"
            )
    last = f"a{ROUNDS}"
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(list_transform(c.e, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256 FROM {last} a JOIN c{ROUNDS} c ON a.cluster = c.cluster"
    )


ORACLE = _oracle()
