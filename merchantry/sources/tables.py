"""Loading of the named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from merchantry.session import ship_package


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder on any file system that Spark reads."""
    ship_package(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
