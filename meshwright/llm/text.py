"""Byte-level text helpers that the operators share inside their tasks.

Texts travel as UTF-8 bytes: every class of characters that the operators
split on is ASCII, so bytes and code points give the same words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_LOWER = bytes(range(ord("a"), ord("z") + 1))
#: A-Z to a-z, all else as it is.
FOLD_CASE = bytes.maketrans(_UPPER, _LOWER)
#: As FOLD_CASE, and every ASCII byte that is neither digit nor letter to a space.
FOLD_WORDS = bytes(
    0x20 if b < 0x80 and not chr(b).isalnum() else FOLD_CASE[b] for b in range(256)
)
#: Rows go through the operators' Python in slices of about so many bytes of text.
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_bucket(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo `buckets`; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(buckets))


def id_crc(value: object) -> int:
    return zlib.crc32(str(value).encode())


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes."""
    return column.cast(pa.string()).cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of `text`; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if held and held + size > SLICE_BYTES:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        yield batch.slice(begin)


def map_slices(
    df: DataFrame,
    text: str,
    task: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str,
) -> DataFrame:
    """mapInArrow with one `task()` per partition, called on bounded slices of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = task()
        for batch in slices(batches, text):
            yield step(batch)

    return df.mapInArrow(run, schema)
