"""One row a key whatever the changes hold, and buckets that a batch does not touch keep their files."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from merchantry.operators import bucketed, merge


def test_changes_that_name_a_key_twice(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, None, 2)], "k long, s string, _new long")
    changes = spark.createDataFrame([(1, "x", None, 1), (1, "y", 5, 2), (1, None, None, 3), (3, "z", 7, 1), (3, None, 8, 2), (None, "n", 1, 1)], "k long, s string, _new long, at int")
    got = {tuple(r) for r in merge.upsert(table, changes, "k", [F.col("at")]).collect()}
    assert got == {(1, "y", 5), (2, None, 2), (3, "z", 8)}
    assert merge.upsert(table, changes.drop("at").repartition(3), "k").count() == 3


def test_curated_values_stay_after_the_first(spark):
    table = spark.createDataFrame([(1, "raw"), (2, "hand"), (3, None)], "k long, s string")
    changes = spark.createDataFrame([(1, "auto", 1), (1, "best", 2), (1, "later", 3), (2, "x", 1), (3, "auto", 1), (3, "raw", 2)], "k long, s string, at int")
    got = merge.keep_curated(table, changes, "k", "s", ["raw", "auto"], [F.col("at")])
    assert {tuple(r) for r in got.collect()} == {(1, "best"), (2, "hand"), (3, "raw")}


def test_last_structs_and_shops(spark):
    table = spark.createDataFrame([(1, (1,), 0), (2, (2,), 0)], "k long, _hit struct<a: int>, t int")
    changes = spark.createDataFrame([(1, (7,), 1), (1, None, 2)], "k long, _hit struct<a: int>, at int")
    got = merge.replaced_structs(table, changes, "k", ["_hit"], {"t": F.lit(9)}, [F.col("at")])
    assert sorted((r.k, r["_hit"], r.t) for r in got.collect()) == [(1, None, 9), (2, (2,), 0)]
    shops = spark.createDataFrame([(1, "a", "c"), (2, "b", "c"), (3, "d", "top")], "k long, name string, kind string")
    fetched = spark.createDataFrame([(1, False, "x", "n", 1), (1, False, "y", "m", 2), (2, False, "z", "n", 1), (2, True, "z", "n", 2), (3, False, "e", "n", 1)], "k long, gone boolean, name string, kind string, at int")
    got = merge.refreshed_shops(shops, fetched, "k", [], "kind", "top", [F.col("at")])
    assert {tuple(r) for r in got.collect()} == {(1, "y", "m"), (3, "e", "top")}


def names(folder):
    return {p.parent.name: p.name for p in Path(folder).rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    folder, schema = str(tmp_path / "t"), "k long, s string"
    rows = {i: f"v{i}" for i in range(400)}
    bucketed.write(spark.createDataFrame(list(rows.items()), schema), folder, "k", 16)
    before = names(folder)
    assert len(before) == 16
    changes = {5: "new", 7: "new", 1000: "added"}
    touched = bucketed.merge(spark, folder, schema, "k", 16, spark.createDataFrame(list(changes.items()), schema), lambda old, new: merge.upsert(old, new, "k"))
    after = names(folder)
    assert {tuple(r) for r in bucketed.read(spark, folder, schema).select("k", "s").collect()} == set((rows | changes).items())
    assert 1 <= len(touched) <= 3 and {b for b in before if after[b] != before[b]} == {f"bucket={n}" for n in touched}
    # A bucket of which nothing is left, and a batch without rows.
    gone = spark.createDataFrame([(k,) for k in range(1001)], "k long").where(bucketed.bucket_of("k", 16) == 3)
    assert bucketed.merge(spark, folder, schema, "k", 16, gone, lambda old, keys: merge.delete(old, keys, "k")) == [3]
    left = {k for (k,) in bucketed.read(spark, folder, schema).select("k").collect()}
    assert left == set(rows | changes) - {r.k for r in gone.collect()} and not (tmp_path / "t" / "bucket=3").exists()
    assert bucketed.merge(spark, folder, schema, "k", 16, gone.limit(0), lambda old, keys: old) == []


def test_a_full_refresh_removes_and_replaces(spark, tmp_path):
    rng = random.Random(2)
    folder, schema = str(tmp_path / "t"), "k long, s string"
    rows = {i: f"v{i}" for i in range(300)}
    bucketed.write(spark.createDataFrame(list(rows.items()), schema), folder, "k", 32)
    before = names(folder)
    assert bucketed.replace(spark, folder, schema, "k", 32, spark.createDataFrame(rng.sample(list(rows.items()), 300), schema)) == []
    assert names(folder) == before
    fresh = {k: v for k, v in rows.items() if k != 17} | {20: "other", 999: "added"}
    changed = bucketed.replace(spark, folder, schema, "k", 32, spark.createDataFrame(list(fresh.items()), schema))
    assert 1 <= len(changed) <= 3 and {tuple(r) for r in bucketed.read(spark, folder, schema).select("k", "s").collect()} == set(fresh.items())
    after = names(folder)
    assert {b for b in before if after.get(b) != before[b]} <= {f"bucket={n}" for n in changed}
