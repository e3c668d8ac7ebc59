"""Tables in buckets of their key: a batch rewrites only the buckets that it touches.

A row lies in the folder of its key's bucket. A merge reads the buckets that its changes name, by partition pruning, and
overwrites those alone; files of other buckets stay as they are. What is written has been checkpointed before, so a task
that is repeated never reads a half-written bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.session import cut

BUCKET = "bucket"


def bucket_of(key: str, buckets: int) -> Column:
    """The bucket of a key; null keys are in bucket 0."""
    return F.when(F.col(key).isNull(), 0).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int")


def write(table: DataFrame, folder: str, key: str, buckets: int) -> None:
    """The whole table, a file or more a bucket. No column of it is called `bucket`."""
    _overwrite(table.withColumn(BUCKET, bucket_of(key, buckets)), folder)


def _overwrite(rows: DataFrame, folder: str) -> None:
    dealt = rows.repartition(BUCKET)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(folder)


def read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, {BUCKET} int").parquet(folder)


def _drop_buckets(spark: SparkSession, folder: str, numbers: list[int]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for n in numbers:
        files.delete(path(f"{folder}/{BUCKET}={n}"), True)


def merge(spark: SparkSession, folder: str, schema: str, key: str, buckets: int, changes: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replaces the touched buckets by step(their rows, changes) and returns their numbers. step works key by key, as the
    functions of operators.merge do."""
    touched = sorted(r[0] for r in changes.select(bucket_of(key, buckets)).distinct().collect())  # at most one a bucket
    if not touched:
        return []
    old = read(spark, folder, schema).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
    new = cut(step(old, changes).withColumn(BUCKET, bucket_of(key, buckets)))
    filled = {r[0] for r in new.select(BUCKET).distinct().collect()}
    _overwrite(new, folder)
    _drop_buckets(spark, folder, [n for n in touched if n not in filled])
    return touched


def replace(spark: SparkSession, folder: str, schema: str, key: str, buckets: int, fresh: DataFrame) -> list[int]:
    """A full refresh (K08): what is not in fresh is removed, the rest replaced or added; buckets whose rows are the same
    stay. Returns the numbers of the buckets that changed."""
    columns = read(spark, folder, schema).drop(BUCKET).columns
    rows = cut(fresh.select(columns).withColumn(BUCKET, bucket_of(key, buckets)))
    sums = lambda t: t.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("b"))
    before, after = sums(read(spark, folder, schema)).alias("x"), sums(rows).alias("y")
    same = F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.a").eqNullSafe(F.col("y.a")) & F.col("x.b").eqNullSafe(F.col("y.b"))
    found = before.join(after, BUCKET, "full_outer").where(~same).select(BUCKET, F.col("y.n").isNull().alias("gone")).collect()  # one row a bucket
    changed = sorted(r[0] for r in found)
    if changed:
        _overwrite(rows.where(F.col(BUCKET).isin(changed)), folder)
        _drop_buckets(spark, folder, [r[0] for r in found if r[1]])
    return changed
