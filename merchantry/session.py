"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: dict[str, str] = {}

#: Settings the operators rely on; none of them changes how a user's own queries are planned.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset (tests on one machine) a folder of this machine is chosen; elsewhere that is an error, for
    executors could not see each other's files.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder; Spark's cleaner removes the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(rows: DataFrame) -> DataFrame:
    """rows of a scan, dealt to all cores where fewer partitions than cores hold any: a file of one row group is read by one
    task, into however many splits it is cut, and what costs time per row then waits for that task. A scan of four splits a
    core or more stays as it is without a look at it; for others the partitions with rows are counted by the files' metadata.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= 4 * cores:
        return rows
    used = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    return rows if used >= cores else rows.repartition(cores)


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session's executors, once an application."""
    sc = spark.sparkContext
    if _SHIPPED.get("id") == sc.applicationId:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    sc.addPyFile(str(path))
    _SHIPPED["id"] = sc.applicationId


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for products that are files."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
