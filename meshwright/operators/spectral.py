"""Singular vectors of a sparse table by block subspace iteration, at ranks of hundreds.

Rows and columns are dealt to blocks of about BLOCK, among names of like many cells (powers of BAND) by
a hash, and numbered inside their block; the cells become tiles (row block, column block). A hub then shares
its block with hubs: where few names meet nearly all others, a block of the others has cells in the hubs'
blocks only, and what is sent grows with the names instead of their square. A block of vectors is one row:
its block's number and a dense array of (members x width) doubles. A product is one cogroup of tiles with the
blocks they need and a sum of the partial blocks, FAN of them at a time, so that a group never
grows with the table; only blocks of more than FAN parts are summed again. Only width x width products
reach the driver.

The width is k and some more, WIDTH at least: a graph whose links meet in fewer hubs than that has fewer
singular values, and two rounds then do, however many names it has. Each round applies the matrix and its transpose, turns the block to
the Ritz directions and measures the residual |A'A v - s^2 v| of the k leading ones; it ends
when all are under `tol` times the largest eigenvalue.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.sources.store import Scratch

BLOCK, FAN, BAND, WIDTH = 2048, 16, 16, 256
_BLOCK = "b int, x binary"


def _frame(x: bytes, width: int) -> np.ndarray:
    return np.frombuffer(x, np.float64).reshape(-1, width)


def _blocks(table: list[tuple[int, np.ndarray]]) -> pa.Table:
    return pa.table({"b": pa.array([b for b, _ in table], pa.int32()), "x": pa.array([x.tobytes() for _, x in table], pa.binary())})


def _numbered(cells: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """name, its block and its place there. Blocks hold names of one band, by how many cells they have."""
    band = F.floor(F.log(float(BAND), F.count("*") + 0.5)).cast("int")
    names = scratch.written(cells.groupBy(name).agg(band.alias("band")), "degrees")
    dealt, first = F.lit(None).cast("int"), 0
    for r in sorted(names.groupBy("band").count().collect()):  # a row for each power of BAND up to the table's length
        n = math.ceil(r["count"] / BLOCK)
        dealt = F.when(F.col("band") == r.band, F.pmod(F.xxhash64(name), F.lit(n)).cast("int") + first).otherwise(dealt)
        first += n
    out = names.select(name, dealt.alias("b"))
    return out.withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy(name)) - 1)


@dataclass
class Tiles:
    """A sparse table in tiles (rb, i, cb, j, value), and the names of its rows and columns."""

    cells: DataFrame
    rows: DataFrame
    columns: DataFrame
    size: dict[str, DataFrame]  # by side: b, n (members of the block)
    many: dict[str, int]  # by side: blocks, empty ones too
    pairs: dict[str, DataFrame]  # by side: rb, cb of tiles with cells, part (their number in the block of that side) and parts (how many it has)
    most: dict[str, int]  # by side: the most parts of a block
    scratch: Scratch

    @classmethod
    def of(cls, cells: DataFrame, row: str, column: str, scratch: Scratch) -> Tiles:
        cells = scratch.written(cells.select(row, column, "value"), "cells")
        rows, columns = (scratch.written(_numbered(cells, c, scratch), "names") for c in (row, column))
        r = rows.select(row, F.col("b").alias("rb"), "i")
        c = columns.select(column, F.col("b").alias("cb"), F.col("i").alias("j"))
        tiles = scratch.written(cells.join(r, row).join(c, column).select("rb", "cb", "i", "j", "value"), "tiles")
        size = {side: scratch.written(names.groupBy("b").agg(F.count("*").alias("n")), "sizes") for side, names in (("rb", rows), ("cb", columns))}
        many = {side: (n.agg(F.max("b")).first()[0] or 0) + 1 for side, n in size.items()}
        met = scratch.written(tiles.select("rb", "cb").distinct(), "pairs")
        pairs, most = {}, {}
        for to, of in (("rb", "cb"), ("cb", "rb")):
            block = Window.partitionBy(to)
            pairs[to] = scratch.written(met.select("rb", "cb", (F.row_number().over(block.orderBy(of)) - 1).alias("part"), F.count("*").over(block).cast("int").alias("parts")), "pairs")
            most[to] = pairs[to].agg(F.max("parts")).first()[0] or 0
        return cls(tiles, rows, columns, size, many, pairs, most, scratch)

    def start(self, width: int, seed: int) -> DataFrame:
        """Random column blocks, the same whenever they are made."""

        def run(batches):
            for batch in batches:
                yield from _blocks([(b, np.random.default_rng((seed, b)).normal(size=(n, width))) for b, n in zip(*(c.to_pylist() for c in batch.columns))]).to_batches()

        return self.size["cb"].mapInArrow(run, _BLOCK)

    def times(self, x: DataFrame, width: int, transposed: bool = False) -> DataFrame:
        """The blocks of A x, or of A' x."""
        to, of, i, j = ("cb", "rb", "j", "i") if transposed else ("rb", "cb", "i", "j")
        n = self.size[to].withColumnRenamed("b", to)
        sent = self.pairs[to].join(n, to).join(x.withColumnRenamed("b", of), of).select(*(F.col(c).alias(c) for c in (to, of, "part", "parts", "n", "x")))
        tiles = self.cells.select(to, of, F.col(i).alias("i"), F.col(j).alias("j"), "value")

        def product(tile: pa.Table, block: pa.Table) -> pa.Table:
            if not tile.num_rows or not block.num_rows:
                return pa.table({"b": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "parts": pa.array([], pa.int32()), "x": pa.array([], pa.binary())})
            source = _frame(block["x"][0].as_py(), width)
            at, weight = tile["i"].to_numpy(), tile["value"].to_numpy()
            order = np.argsort(at, kind="stable")
            at, begin = np.unique(at[order], return_index=True)
            out = np.zeros((block["n"][0].as_py(), width))
            grown = np.empty((min(len(order), 8192), width))
            ends = [*begin[1:], len(order)]
            first = 0
            while first < len(at):  # rows are summed some thousand cells at a time
                last = first + 1
                while last < len(at) and ends[last] - begin[first] <= len(grown):
                    last += 1
                some = order[begin[first] : ends[last - 1]]
                out[at[first:last]] = np.add.reduceat(source[tile["j"].to_numpy()[some]] * weight[some, None], begin[first:last] - begin[first], axis=0)
                first = last
            return pa.table({"b": pa.array([tile[to][0].as_py()], pa.int32()), "part": block["part"], "parts": block["parts"], "x": pa.array([out.tobytes()], pa.binary())})

        parts = tiles.groupBy(to, of).cogroup(sent.groupBy(to, of)).applyInArrow(product, _PART)
        first = self.scratch.written(_fewer(parts), "block")
        if self.most[to] <= FAN:
            return first
        rest = _fewer(first.where("parts > 1"))
        for _ in range(math.ceil(math.log(self.most[to], FAN) - 1e-9) - 2):
            rest = _fewer(rest)
        return self.scratch.together([first, again := self.scratch.written(rest, "block")], first.where("parts = 1").unionByName(again))


_PART = "b int, part int, parts int, x binary"


def _fewer(parts: DataFrame) -> DataFrame:
    """The sums of FAN partial blocks (b, part, parts, x) each; `parts` is how many a block then has."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(0)
        for x in table["x"]:
            one = np.frombuffer(x.as_py(), np.float64)
            total = total + one if len(total) else one.copy()
        some = [pa.array([table[c][0].as_py()], pa.int32()) for c in ("part", "parts")]
        return pa.table({"b": table["b"][:1], "part": pa.array([some[0][0].as_py() // FAN], pa.int32()), "parts": pa.array([-(-some[1][0].as_py() // FAN)], pa.int32()), "x": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy("b", F.floor(F.col("part") / FAN)).applyInArrow(add, _PART)


def gram(x: DataFrame, width: int, many: int) -> np.ndarray:
    """x'x, a width x width array."""

    def products(batches):
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = _frame(raw.as_py(), width)
                yield pa.record_batch([pa.array([c], pa.int32()) for c in (0, b, many)] + [pa.array([(block.T @ block).tobytes()], pa.binary())], names=["b", "part", "parts", "x"])

    parts = x.select("b", "x").mapInArrow(products, _PART)
    while many > 1:
        parts, many = _fewer(parts), math.ceil(many / FAN)
    total = parts.collect()  # one row, or none without cells
    return np.frombuffer(total[0].x, np.float64).reshape(width, width) if total else np.zeros((width, width))


def turned(x: DataFrame, w: np.ndarray) -> DataFrame:
    """The blocks times a small array."""

    def run(batches):
        for batch in batches:
            yield from _blocks([(b, _frame(raw.as_py(), len(w)) @ w) for b, raw in zip(batch.column(0).to_pylist(), batch.column(1))]).to_batches()

    return x.select("b", "x").mapInArrow(run, _BLOCK)


def _orthonormal(g: np.ndarray) -> np.ndarray:
    """w with w'gw = 1 on what g spans; directions that it doesn't span become 0."""
    scale = 1 / np.sqrt(np.maximum(np.diag(g), 1e-300))
    value, vector = np.linalg.eigh(g * scale[:, None] * scale)
    kept = value > 1e-12 * max(value.max(initial=0), 1e-300)
    return scale[:, None] * vector * np.where(kept, 1 / np.sqrt(np.where(kept, value, 1)), 0)


@dataclass
class Spectrum:
    vectors: DataFrame  # the row's name and v, its entries of the left singular vectors
    columns: DataFrame  # the column's name and v, its entries of the right ones
    values: list[float]
    residual: float  # the largest |A'A v - s^2 v| over the largest s^2
    rounds: int


def decompose(cells: DataFrame, row: str, column: str, k: int, tol: float = 1e-6, rounds: int = 40, seed: int = 3) -> Spectrum:
    """The k leading singular values of the cells (row, column, value) and their left vectors.

    Fewer rows or columns than k give values of 0 behind the rank.
    """
    scratch = Scratch(cells.sparkSession)
    tiles = Tiles.of(cells, row, column, scratch)
    width = max(WIDTH, k + k // 4)
    columns, rows = tiles.many["cb"], tiles.many["rb"]
    x = scratch.written(tiles.start(width, seed), "block")
    x = turned(x, _orthonormal(gram(x, width, columns)))
    done, old = 0, []
    while True:
        done += 1
        y = tiles.times(x, width)
        value, w = np.linalg.eigh(gram(y, width, rows))
        order = np.argsort(-value)
        value, w = np.maximum(value[order], 0), w[:, order]
        z = tiles.times(turned(y, w), width, transposed=True)
        zz = gram(z, width, columns)
        apart = np.sqrt(np.maximum(np.diag(zz) - value**2, 0))[:k]
        residual = float(apart.max(initial=0) / max(value.max(initial=0), 1e-300))
        if residual <= tol or done >= rounds:
            break
        x = scratch.written(turned(z, _orthonormal(zz)), "block")
        scratch.drop(old)
        old = [f for f in (x, y, z)]
    length = np.sqrt(value[:k])
    unit = w[:, :k] * np.where(length > 1e-12 * max(length.max(initial=0), 1e-300), 1 / np.where(length > 0, length, 1), 0)
    left, right = _spread(y, unit), _spread(x, w[:, :k])
    return Spectrum(tiles.rows.join(left, ["b", "i"]).select(row, "v"), tiles.columns.join(right, ["b", "i"]).select(column, "v"), length.tolist(), residual, done)


def _spread(x: DataFrame, w: np.ndarray) -> DataFrame:
    """The rows of the blocks times a small array, one by one: b, i, v."""

    def run(batches):
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = _frame(raw.as_py(), len(w)) @ w
                yield pa.record_batch([pa.array(np.full(len(v), b, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(list(v), pa.list_(pa.float64()))], names=["b", "i", "v"])

    return x.select("b", "x").mapInArrow(run, "b int, i int, v array<double>")
