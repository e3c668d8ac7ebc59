"""Order, paging and queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1). The order must end in a unique column, or pages overlap between runs. Spark plans limit
    over offset over sort as one top-k, so no full sort is written out."""
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_info(total: Column, number: int, size: int) -> list[Column]:
    """pages, previous and next; 0 stands for none."""
    pages = F.ceil(total / F.lit(size)).cast("long")
    return [
        pages.alias("pages"),
        F.lit(number - 1 if number > 1 else 0).cast("long").alias("previous"),
        F.when(F.lit(number) < pages, number + 1).otherwise(0).cast("long").alias("next"),
    ]


def head_of_queue(rows: DataFrame, state: Column, order: Sequence[Column]) -> DataFrame:
    """The one row that is next."""
    return rows.where(state).orderBy(*order).limit(1)


def after_mark(rows: DataFrame, time: str, key: str, mark: tuple[object, object], most: int) -> DataFrame:
    """The next `most` rows after a mark (time, key). The mark holds the key too, so that rows which share the last time
    across a batch edge are not skipped."""
    later = (F.col(time) > F.lit(mark[0])) | ((F.col(time) == F.lit(mark[0])) & (F.col(key) > F.lit(mark[1])))
    # The first test alone is a range that a scan can prune by.
    return rows.where((F.col(time) >= F.lit(mark[0])) & later).orderBy(time, key).limit(most)


def backlog(rows: DataFrame, unset: Column, order: Sequence[Column], most: int) -> DataFrame:
    return rows.where(unset).orderBy(*order).limit(most)


def allocate_ids(rows: DataFrame, order: Sequence[str], start: int, name: str, slices: int = 64) -> DataFrame:
    """Numbers rows from start + 1 in the given order of a unique key, without sorting all rows in one task.

    Rows are split into ranges of the first order column, given by approximate quantiles; numbers are a range's start
    plus the place within it.
    """
    first = order[0]
    edges = rows.stat.approxQuantile(first, [i / slices for i in range(1, slices)], 0.001)
    part = sum((F.col(first) > F.lit(e)).cast("int") for e in sorted(set(edges))) if edges else F.lit(0)
    parted = rows.withColumn("_part", part)
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # at most `slices` rows
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", before.alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = parted.withColumn("_place", place).join(F.broadcast(starts), "_part")
    return numbered.withColumn(name, (F.lit(start) + F.col("_start") + F.col("_place")).cast("long")).drop("_part", "_start", "_place")


def write_by_mark(rows: DataFrame, folder: str, mark: str, row_group_bytes: int = 16 << 20) -> None:
    """Parquet files in ranges of a mark, sorted within: a scan after a mark, or down to a cutoff, skips the files and
    row groups that lie before it by their statistics (S05, S06, P20)."""
    ordered = rows.repartitionByRange(mark).sortWithinPartitions(mark)
    ordered.write.mode("overwrite").option("parquet.block.size", row_group_bytes).parquet(folder)
