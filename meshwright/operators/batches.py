"""Work over a table in batches, with a record of progress; a run that stops goes on where it was.

The rows are written once, a folder a batch. Each batch is a Spark job that reads its folder only, writes its result
over what an earlier try may have left, and then its line of the record with the counts that
`DataFrame.observe` saw pass. A batch with a line is done and isn't run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from meshwright.sources import store

_RECORD = "batch int, status string, remarks string, progress_num long, progress_den long, created timestamp, updated timestamp"


class Batches:
    """A job of `name` over rows in `path`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, name: str = "batch"):
        self.spark, self.path, self.name = spark, path, name

    def _exists(self, part: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def prepare(self, rows: DataFrame, batch: Column) -> Batches:
        """Deals the rows to batches by a whole number; only the first call writes."""
        if not self._exists("rows/_SUCCESS"):
            rows.withColumn("batch", batch.cast("int")).write.mode("overwrite").partitionBy("batch").parquet(f"{self.path}/rows")
            n = self.spark.read.parquet(f"{self.path}/rows").groupBy("batch").agg(F.count("*").alias("n"), F.current_timestamp().alias("created"))
            n.write.mode("overwrite").parquet(f"{self.path}/sizes")
        return self

    def record(self) -> DataFrame:
        """A line for every batch: its status, rows done and rows in all."""
        sizes = self.spark.read.parquet(f"{self.path}/sizes")
        done = self.spark.read.schema("batch int, num long, updated timestamp").parquet(f"{self.path}/done") if self._exists("done") else self.spark.createDataFrame([], "batch int, num long, updated timestamp")
        status = F.when(F.col("num").isNull(), "waiting").otherwise("done")
        both = sizes.join(done, "batch", "left")
        return both.select("batch", status.alias("status"), F.lit(self.name).alias("remarks"), F.coalesce("num", F.lit(0)).alias("progress_num"), F.col("n").alias("progress_den"), "created", F.coalesce("updated", "created").alias("updated"))

    def run(self, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The results of `work` on every batch, each batch worked on once; `work` is given a batch's rows."""
        waiting = [r.batch for r in self.record().where("status = 'waiting'").select("batch").orderBy("batch").collect()]
        for batch in waiting:
            seen = Observation()
            rows = self.spark.read.parquet(f"{self.path}/rows/batch={batch}").observe(seen, F.count(F.lit(1)).alias("num"))
            work(rows).write.mode("overwrite").parquet(f"{self.path}/results/batch={batch}")
            line = self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(seen.get["num"]).cast("long").alias("num"), F.current_timestamp().alias("updated"))
            line.coalesce(1).write.mode("append").parquet(f"{self.path}/done")
        return self.spark.read.parquet(f"{self.path}/results").drop("batch")


def in_batches(rows: DataFrame, batch: Column, work: Callable[[DataFrame], DataFrame], name: str = "batch") -> tuple[DataFrame, DataFrame]:
    """A new job from its begin to its end: the results and the record."""
    spark = rows.sparkSession
    job = Batches(spark, store.fresh(spark, name), name).prepare(rows, batch)
    return job.run(work), job.record()
