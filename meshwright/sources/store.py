"""Tables that are written once to the folder driver and executors share, and read from there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The source's version and the path of what this process has written, by application, source folder and name.
_PATHS: dict[tuple[str, str, str], tuple[tuple[int, int], str]] = {}
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only a local session may go without the setting."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp())
    return context.getCheckpointDir()


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Jobs in here give up their shuffle files as they end; else these stay until the driver collects its garbage."""
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)


def _write(df: DataFrame, path: str) -> DataFrame:
    with released(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """`df` as Parquet, read back: lineage ends, and readers take only the columns they need."""
    return _write(df, fresh(df.sparkSession, name))


class Scratch:
    """Tables written for one job; those that it no longer needs can go before the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, list[str]] = {}

    def written(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = fresh(self.spark, name)
        out = _write(df, path)
        self.paths[id(out)] = [path]
        return out

    def together(self, frames: list[DataFrame], out: DataFrame) -> DataFrame:
        """`out`, which reads the tables behind `frames`; these then go when it goes."""
        self.paths[id(out)] = [path for df in frames for path in self.paths.pop(id(df))]
        return out

    def drop(self, frames: list[DataFrame]) -> None:
        """Deletes the tables behind `frames`, which nothing may read any more."""
        for df in frames:
            for path in self.paths.pop(id(df)):
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _complete(spark: SparkSession, path: str) -> bool:
    """A table that was written whole and is still there."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def fingerprint(spark: SparkSession, source: str) -> tuple[int, int]:
    """Number and digest of the files of a source: another one when a file comes, goes or is written again."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(source)
    each = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    row = files.select(each.alias("h")).agg(F.count("*").alias("n"), F.sum("h").alias("h")).first()
    return row.n, int(row.h or 0)


def stored(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], by: list[str] | None = None, version: tuple[int, int] | None = None) -> DataFrame:
    """The table `name` of `source` in its present version, built on first use.

    Dealt and sorted by `by`, so that files and row groups are skipped by its first column; the columns behind it
    split the rows of a value that has many. When the source has changed, the table is built again and the
    copy of the old version goes.
    """
    version = fingerprint(spark, source) if version is None else version
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _PATHS or _PATHS[key][0] != version or not _complete(spark, _PATHS[key][1]):
        df, scratch = build(), Scratch(spark)
        path = fresh(spark, name)
        if by is not None:  # written first, as dealing by range reads it twice
            raw = scratch.written(df, f"{name}-unsorted")
            raw.repartitionByRange(*by).sortWithinPartitions(*by).write.parquet(path)
            scratch.drop([raw])
        else:
            df.write.parquet(path)
        old = _PATHS.get(key)
        _PATHS[key] = version, path
        if old is not None:
            delete(spark, old[1])
    return spark.read.parquet(_PATHS[key][1])
