"""Language identification by a blended-spectrum string kernel.

A text's features are the byte n-grams of 1 to 3 bytes that occur in it (presence,
over the whole text), hashed to DIM cells. The kernel of two texts is their number of
shared features over the root of the product of their feature counts. A Nyström map on
landmark texts and one-versus-rest kernel ridge regression give one weight per
landmark and language; scoring is a batched matrix product of presence rows with
the landmarks' rows.

The fit uses about TRAIN_ROWS labelled rows, 2 * TRAIN_ROWS at most, spread evenly over all
languages and chosen by a hash of doc_id, and LANDMARKS of these, one of each language at least.

Defined cases: a null text, or one without a letter, is `und` with score 0; without
labelled rows everything is `und`; rows with a null doc_id aren't held out; repeated
rows each get their own row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .shared import cut

DIM = 1 << 14
TRAIN_ROWS = 3000
LANDMARKS = 120
RIDGE = 1e-3
BLOCK = 128
#: ASCII bytes that aren't letters count as spaces.
_FOLD = bytes(0x20 if b < 0x80 and not chr(b).isalpha() else b for b in range(256))


def features(text: str) -> np.ndarray:
    """The cells of a text's n-grams, with repetition."""
    a = np.frombuffer(b" %b " % text.lower().encode().translate(_FOLD), np.uint8).astype(np.uint32)
    two = a[:-1] << 8 | a[1:]
    three = two[:-1] << 8 | a[2:]
    # multiplicative hashes; the lengths get their own multipliers
    return np.concatenate(((a * np.uint32(40503)) & 0xFF, (two * np.uint32(2654435761)) >> 18, (three * np.uint32(2246822519)) >> 18))


def presence(texts: list[str], out: np.ndarray | None = None) -> np.ndarray:
    """Rows of 0 and 1."""
    out = np.zeros((len(texts), DIM), np.float32) if out is None else out
    for row, text in zip(out, texts):
        row[features(text)] = 1
    return out


def has_letter(text: str | None) -> bool:
    """A character of Unicode's category L; digits and number signs aren't."""
    return bool(text) and any(map(str.isalpha, text))


class Model:
    """Landmark rows (cells x landmarks, scaled) and weights (landmarks x languages)."""

    def __init__(self, bits: np.ndarray, langs: list[str]):
        rows = np.unpackbits(bits, axis=1)
        self.langs = sorted(set(langs))
        each = max(1, LANDMARKS // len(self.langs))
        chosen = np.concatenate([np.flatnonzero(np.array(langs) == name)[:each] for name in self.langs])
        marks = rows[chosen].astype(np.float32)
        self.marks = np.ascontiguousarray((marks / np.sqrt(marks.sum(1, keepdims=True))).T)
        k_nm = np.concatenate([self.kernel(rows[i : i + 256].astype(np.float32)) for i in range(0, len(rows), 256)])
        k_mm = self.kernel(marks)
        values, vectors = np.linalg.eigh(k_mm.astype(np.float64))
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])  # the Nyström map
        phi = k_nm @ root
        target = np.where(np.array(langs)[:, None] == np.array(self.langs), 1.0, -1.0)
        weight = np.bincount(np.searchsorted(self.langs, langs))
        scale = 1 / weight[np.searchsorted(self.langs, langs)][:, None]  # languages count alike
        left = (phi * scale).T @ phi + RIDGE * np.eye(phi.shape[1])
        self.weights = (root @ np.linalg.solve(left, (phi * scale).T @ target)).astype(np.float32)

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        return rows @ self.marks / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))

    def decide(self, rows: np.ndarray) -> np.ndarray:
        return self.kernel(rows) @ self.weights


def _clean(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.coalesce(tx.id_bucket("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
    )


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model of the labelled rows that aren't held out; None without any."""
    labelled = _clean(docs).where("not held_out and lang is not null and text is not null")
    shares = cut(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    languages = shares.count()
    if not languages:
        return None
    # every language has a share of the rows, a row each at least
    shares = shares.select("lang", (F.lit(max(1.0, rows / languages)) / F.col("n")).alias("share"))
    labelled = labelled.join(shares, "lang")
    place = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) / float(1 << 30)

    def run(batches):
        for batch in tx.slices(batches, "text"):
            kept = [(t, n) for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_letter(t)]
            bits = [np.packbits(presence([t])[0].astype(np.uint8)).tobytes() for t, _ in kept]
            yield pa.record_batch([pa.array(bits, pa.binary()), pa.array([n for _, n in kept], pa.string())], names=["bits", "lang"])

    sample = labelled.where(place < F.col("share")).select("text", "lang").mapInArrow(run, "bits binary, lang string")
    got = sorted((r.lang, bytes(r.bits)) for r in sample.limit(2 * rows).collect())
    if not got:
        return None
    order = np.random.default_rng(7).permutation(len(got))  # landmarks come first of each language
    bits = np.frombuffer(b"".join(got[i][1] for i in order), np.uint8).reshape(len(got), -1)
    return Model(bits, [got[i][0] for i in order])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task():
        fitted: Model | None = shared.value
        block = np.zeros((BLOCK, DIM), np.float32)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            names, sure = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if fitted and has_letter(t)]
            for at in range(0, len(known), BLOCK):
                part = known[at : at + BLOCK]
                rows = block[: len(part)]
                rows[:] = 0
                values = fitted.decide(presence([texts[i] for i in part], rows))
                for i, best, v in zip(part, values.argmax(1), values.max(1)):
                    names[i], sure[i] = fitted.langs[best], float(min(1.0, max(0.0, (v + 1) / 2)))
            return pa.record_batch([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

        return step

    rows = _clean(docs).select("doc_id", "text", "held_out")
    return tx.map_slices(rows, "text", task, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: a language for every document."""
    docs = tx.documents(spark, sf_dir)
    return identify(docs, fit(docs))
