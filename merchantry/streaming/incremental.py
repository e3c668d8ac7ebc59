"""Polling jobs as streams and as batches with stored marks.

A stream reads new files of a folder and hands each micro-batch to a merge into a state table. State is written as a new
version and named by the batch, so a batch that is repeated after a failure gives the same version again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from merchantry.operators import merge, paging


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class VersionedTable:
    """A small state table as numbered Parquet folders; a version is complete when Spark has committed it."""

    def __init__(self, spark: SparkSession, folder: str, empty: DataFrame) -> None:
        self.spark, self.folder, self.empty = spark, folder.rstrip("/"), empty

    def version(self, number: int) -> DataFrame:
        """The newest version up to a number; empty before the first."""
        while number >= 0:
            if _exists(self.spark, f"{self.folder}/v{number}/_SUCCESS"):
                return self.spark.read.schema(self.empty.schema).parquet(f"{self.folder}/v{number}")
            number -= 1
        return self.empty

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/v{number}")


def merged_stream(source: DataFrame, state: VersionedTable, step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> int:
    """Runs all available micro-batches: state version b is step(state before b, batch b). Returns the last batch."""
    last = [-1]

    def one(batch: DataFrame, number: int) -> None:
        state.write(step(state.version(number - 1), batch), number)
        last[0] = number

    query = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return last[0]


def counting(key: str, count: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A step that adds the counts of a batch."""
    return lambda state, batch: merge.add_counts(state, batch, key, count)


def files(spark: SparkSession, path: str, schema: StructType, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def windowed(events: DataFrame, time: str, late: str, width: str, key: str, value: str) -> DataFrame:
    """Counts and sums by tumbling window and key, with a watermark for late rows; for batches and streams."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def read_batch(rows: DataFrame, marks: DataFrame, job: str, time: str, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """The next batch of a job after its mark, and the marks with the batch's last (time, key) (R01, R09). marks: job,
    time, key; one row a job, so two jobs never share a mark. An empty batch leaves the mark as it was."""
    found = marks.where(F.col("job") == job).select(time, key).first()
    batch = rows.orderBy(time, key).limit(most) if found is None else paging.after_mark(rows, time, key, (found[0], found[1]), most)
    end = batch.agg(F.max(F.struct(time, key)).alias("m")).where("m is not null").select(F.lit(job).alias("job"), f"m.{time}", f"m.{key}")
    others = marks.where(F.col("job") != job).unionByName(marks.where(F.col("job") == job).join(end.select("job"), "job", "left_anti"))
    return batch, others.unionByName(end)


def retried(failed: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The retry table after a round (R08): tried rows leave, those that failed softly come back. results: key, soft."""
    left = failed.join(results.select(key).distinct(), key, "left_anti")
    return left.unionByName(results.where("soft").select(key).distinct(), allowMissingColumns=True)
