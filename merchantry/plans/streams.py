"""Streaming queries: their final state equals the batch result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.session import new_folder
from merchantry.sources.tables import table
from merchantry.streaming import incremental


def _landed(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    """Events as a folder of files in order of time, as a feed would leave them; returns the table."""
    events = table(spark, sf, "events")
    events.repartitionByRange(8, "ts").write.parquet(f"{folder}/landed")
    return events


def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Event counts by type, merged batch by batch into a state table."""
    folder = new_folder(spark, "counts")
    schema = _landed(spark, sf, folder).schema
    state = incremental.VersionedTable(spark, f"{folder}/state", spark.createDataFrame([], "event_type string, n long"))
    source = incremental.files(spark, f"{folder}/landed", schema, per_batch=3)
    return state.version(incremental.merged_stream(source, state, incremental.counting("event_type", "n"), f"{folder}/checkpoint"))


def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour sums by event type of a stream with a watermark, as complete as the stream has closed them."""
    folder = new_folder(spark, "windows")
    schema = _landed(spark, sf, folder).schema
    source = incremental.files(spark, f"{folder}/landed", schema).withColumn("t", F.col("ts").cast("timestamp"))
    grouped = incremental.windowed(source, "t", "0 seconds", "6 hours", "event_type", "value")
    query = grouped.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    rows = spark.read.parquet(f"{folder}/out")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def marked_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Two jobs that read the same orders by marks of their own: the third batch of one, the first of the other."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    marks = spark.createDataFrame([("early", dt.datetime(1995, 6, 1), 0)], "job string, o_orderdate timestamp_ntz, o_orderkey long")
    for _ in range(3):
        batch, marks = incremental.read_batch(rows, marks, "early", "o_orderdate", "o_orderkey", 300)
    other, _ = incremental.read_batch(rows, marks, "late", "o_orderdate", "o_orderkey", 100)
    return batch.select(F.lit("early").alias("job"), "o_orderkey").union(other.select(F.lit("late").alias("job"), "o_orderkey"))


QUERIES = {f.__name__: f for f in (stream_counts, stream_windows, marked_batches)}
SQL = {
    "stream_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    # A stream closes a window when a later time has been seen: all but those that hold the last time.
    "stream_windows": """
        SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
        FROM events WHERE time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS <= (SELECT max(ts) FROM events) GROUP BY ALL""",
    "marked_batches": """
        SELECT 'early' AS job, o_orderkey FROM (SELECT o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1995-06-01', 0)
            ORDER BY o_orderdate, o_orderkey LIMIT 300 OFFSET 600) a
        UNION ALL SELECT 'late', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100) b""",
}
