"""Captured pages as a data source; scans that skip what lies before their mark."""

import json

from pyspark.sql import functions as F

from merchantry.operators import paging
from merchantry.sources import feed

ITEM = "struct<id: long, name: string>"


def land(folder, offset, rows):
    page = folder / f"offset={offset}"
    page.mkdir(parents=True)
    (page / "part-0.txt").write_text(json.dumps(rows))
    (page / "_SUCCESS").write_text("")


def test_a_restarted_stream_reads_no_page_twice(spark, tmp_path):
    rows = [{"id": i, "name": f"n{i}"} for i in range(23)]
    pages, out, checkpoint = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def take():
        query = feed.feed_stream(spark, str(pages), ITEM, 5).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    for k in (0, 5):
        land(pages, k, rows[k : k + 5])
    assert take() == list(range(10))
    (pages / "offset=0" / "part-0.txt").write_text("[]")  # a page that was taken is not looked at again
    land(pages, 15, rows[15:20])  # the page before it is still missing
    assert take() == list(range(10))
    land(pages, 10, rows[10:15])
    land(pages, 20, rows[20:])
    land(pages, 25, [])
    assert take() == list(range(23)) == take()
    whole = feed.feed(spark, str(pages), ITEM)
    assert sorted(r.id for r in whole.collect()) == list(range(5, 23)) and whole.where("offset = 10").count() == 5


def test_captured_rows_come_back(spark, tmp_path):
    rows = spark.range(37).select(F.col("id").alias("place"), "id", F.concat(F.lit('q"'), F.col("id").cast("string")).alias("name"))
    feed.capture(rows, "place", 10, f"file://{tmp_path}/in")
    got = feed.feed(spark, f"file://{tmp_path}/in", ITEM)
    assert sorted((r.offset, r.id, r.name) for r in got.collect()) == sorted((i // 10 * 10, i, f'q"{i}') for i in range(37))
    assert feed.feed(spark, str(tmp_path / "none"), ITEM).count() == 0


def scanned(frame):
    """Rows that the scan of a collected frame gave."""
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numOutputRows").value()


def test_scans_skip_what_lies_before_the_mark(spark, tmp_path):
    rows = spark.range(0, 60_000).select(((F.col("id") * 7919) % 60_000).alias("t"), F.sha2(F.col("id").cast("string"), 256).alias("s"))
    paging.write_by_mark(rows, str(tmp_path / "by"), "t", row_group_bytes=64 << 10)
    rows.repartition(4).write.parquet(str(tmp_path / "mixed"))
    for name, least in (("by", 6_000), ("mixed", 60_000)):
        late = spark.read.parquet(str(tmp_path / name)).where("t > 57000")
        assert sorted(r.t for r in late.collect()) == list(range(57_001, 60_000))
        assert (scanned(late) < 30_000) == (name == "by")
    after = paging.after_mark(spark.read.parquet(str(tmp_path / "by")), "t", "s", (59_990, "~"), 5)
    assert [r.t for r in after.collect()] == [59_991, 59_992, 59_993, 59_994, 59_995]
