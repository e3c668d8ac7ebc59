"""Table rewrites, trees and properties."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.functions import numbers, props
from merchantry.operators import bucketed, merge, paging, tree
from merchantry.session import new_folder
from merchantry.sources import feed
from merchantry.sources.tables import table


def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Orders up to 1996, with a batch of those from 1995 on whose price is known and whose priority is not."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", F.year("o_orderdate").alias("y"))
    changes = orders.where("y >= 1995").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(None).cast("string").alias("o_orderpriority"))
    return merge.upsert(orders.where("y <= 1996").drop("y"), changes, "o_orderkey").withColumn("o_totalprice", F.round("o_totalprice", 2))


def bucket_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The same batch merged into a table in buckets, in two parts, each rewriting the buckets that it touches."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority", F.year("o_orderdate").alias("y"))
    changes = orders.where("y >= 1995").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(None).cast("string").alias("o_orderpriority"))
    folder, schema = new_folder(spark, "orders"), "o_orderkey long, o_totalprice double, o_orderpriority string"
    bucketed.write(orders.where("y <= 1996").drop("y"), folder, "o_orderkey", 16)
    for part in (F.col("o_orderkey") % 16 == 0, F.col("o_orderkey") % 16 != 0):
        bucketed.merge(spark, folder, schema, "o_orderkey", 16, changes.where(part), lambda old, new: merge.upsert(old, new, "o_orderkey"))
    return bucketed.read(spark, folder, schema).drop(bucketed.BUCKET).withColumn("o_totalprice", F.round("o_totalprice", 2))


def mark_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Events after a mark, read from files in ranges of the mark."""
    folder = new_folder(spark, "marks")
    paging.write_by_mark(table(spark, sf, "events"), folder, "ts")
    return spark.read.parquet(folder).where(F.col("ts") > dt.datetime(2024, 1, 20)).select("event_id", "event_type")


def feed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as the pages of a feed, read by a stream that is started twice."""
    folder, count = new_folder(spark, "feed"), 100
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("place"), "c_custkey", "c_name", "c_acctbal")
    half = F.lit(rows.count() // (2 * count) * count)
    for part in (F.col("place") < half, F.col("place") >= half):
        feed.capture(rows.where(part), "place", count, f"{folder}/in")
        source = feed.feed_stream(spark, f"{folder}/in", "struct<c_custkey: long, c_name: string, c_acctbal: double>", count)
        writer = source.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
        writer.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("offset")


def counter_merge(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    old = events.where(F.col("ts") < dt.datetime(2024, 1, 15)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return merge.add_counts(old, events.where(F.col("ts") >= dt.datetime(2024, 1, 15)), "event_type", "n")


def partial_update(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    chosen = table(spark, sf, "lineitem").where("l_quantity >= 50 and l_suppkey < 3").select(F.col("l_partkey").alias("p_partkey"))
    return merge.set_where(parts, chosen, "p_partkey", {"p_size": F.col("p_size") + 100})


def refresh_records(spark: SparkSession, sf: str) -> DataFrame:
    """Known documents (all but German ones; those under 400 characters without a title) seen again (all but French ones)
    with their whole text as title."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("title"), F.coalesce("lang", F.lit("")).alias("lang"), "n_chars")
    none = F.lit(None).cast("timestamp_ntz")
    old = docs.where("lang <> 'de'").select("doc_id", F.when(F.col("n_chars") >= 400, F.col("title")).alias("title"), none.alias("created_time"), none.alias("refresh_time"), F.lit(False).alias("refreshed"), F.lit(True).alias("uploaded"))
    return merge.insert_or_refresh(old, docs.where("lang <> 'fr'").select("doc_id", "title"), "doc_id", F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz"))


def delete_keys(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return merge.delete(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), keys, "o_orderkey")


def insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of all segments but one, to which those of several segments, that one too, are added."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    known = customers.where("c_mktsegment <> 'BUILDING'").drop("c_mktsegment")
    return merge.insert_absent(known, customers.where("c_mktsegment < 'G'").drop("c_mktsegment"), "c_custkey")


def unbind_items(spark: SparkSession, sf: str) -> DataFrame:
    return merge.unbind(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 7)


def keep_curated(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    changes = orders.select("o_orderkey", F.lit("9-NEW").alias("o_orderpriority")).where("o_orderkey % 2 = 1")
    return merge.keep_curated(orders, changes, "o_orderkey", "o_orderpriority", ["5-LOW", "4-NOT SPECIFIED"])


def claim_head(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    order = ["o_orderpriority", "o_orderdate", "o_orderkey"]
    return merge.claim(orders, "o_orderkey", "o_orderstatus", [F.col(c) for c in order], "O", "C").select("o_orderkey", "o_orderstatus")


def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return merge.latest(events, ["user_id"], [F.col("ts"), F.col("event_id")])


def id_allocate(spark: SparkSession, sf: str) -> DataFrame:
    return paging.allocate_ids(table(spark, sf, "part").select("p_partkey", "p_name"), ["p_partkey"], 1000, "group_id")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    region = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nation = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    leaves = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return region.union(nation).union(leaves)


def tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").groupBy(F.concat(F.lit("c"), "o_custkey").alias("node"))
    counts = orders.agg(F.count(F.lit(1)).alias("item_num"), F.count_if(F.col("o_totalprice") > 300000).alias("selection_num"))
    return tree.rollup(_edges(spark, sf), counts, ["item_num", "selection_num"])


def tree_path(spark: SparkSession, sf: str) -> DataFrame:
    edges = _edges(spark, sf)
    return tree.paths(edges, edges.select("node", "name"))


def tree_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return tree.descendants(_edges(spark, sf), "r2")


def full_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """A category document, as a sync service sends it, flattened to parents and children with ids."""
    nations = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("name")))).alias("children"))
    nodes = table(spark, sf, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    one = nodes.agg(F.array_sort(F.collect_list(F.struct("r_regionkey", F.col("r_name").alias("name"), "children"))).alias("t"))
    text = one.select(F.to_json("t").alias("body"))
    parsed = text.select(F.from_json("body", "array<struct<name string, children array<struct<name string>>>>").alias("t"))
    return parsed.select(F.explode(F.concat(*tree.flatten(F.col("t"), levels=2))).alias("row")).select("row.*")


def _prop_text() -> Column:
    return F.concat(F.lit("1:"), "p_size", F.lit(":size:"), "p_size", F.lit(";bad;2:"), "p_brand", F.lit(":brand:"), "p_brand", F.lit(";1:9:size:"), "p_type", F.lit(";x:y:z"))


def prop_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = props.props_map(_prop_text())
    rows = table(spark, sf, "part").select("p_partkey", found.alias("m"))
    return rows.select("p_partkey", F.size("m").alias("n_props"), props.prop(F.col("m"), "brand").alias("brand"), props.prop(F.col("m"), "none", "size").alias("size"))


def prop_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(_prop_text().alias("props_name"), "p_type")
    return props.prop_counts(rows, "props_name", "p_type")


def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    rows = table(spark, sf, "events").select(k.alias("k"), "value")
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def brand_counts_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Brand counts of new parts added to the old totals, with the merged probability."""
    parts = table(spark, sf, "part")
    old = parts.where("p_partkey % 2 = 0").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    new = parts.where("p_partkey % 2 = 1").groupBy("p_brand").agg(F.count(F.lit(1)).alias("f"))
    totals = old.agg(F.sum("n").alias("n_all")).crossJoin(new.agg(F.sum("f").alias("f_all")))  # one row beside one row
    rows = old.join(new, "p_brand").join(F.broadcast(totals))
    merged = numbers.merged_probability(F.col("n"), F.col("n") / F.col("n_all"), F.col("f"), F.col("f_all"))
    return rows.select("p_brand", (F.col("n") + F.col("f")).alias("freq"), F.round(merged, 8).alias("prob"))


QUERIES = {
    f.__name__: f
    for f in (
        upsert_merge, bucket_upsert, mark_scan, feed_pages, counter_merge, partial_update, refresh_records, delete_keys, insert_absent, unbind_items, keep_curated,
        claim_head, latest_per_key, id_allocate, tree_rollup, tree_path, tree_descendants, full_refresh, prop_pairs, prop_counts,
        json_fields, brand_counts_merge,
    )
}

_EDGES = """
    SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer"""
_CLOSURE = f"""WITH RECURSIVE e AS ({_EDGES}), up(node, ancestor, distance) AS (
    SELECT node, node, 0 FROM e UNION ALL
    SELECT u.node, e.parent, u.distance + 1 FROM up u JOIN e ON u.ancestor = e.node WHERE e.parent IS NOT NULL)"""

SQL = {
    "upsert_merge": """
        SELECT o_orderkey, round(CASE WHEN year(o_orderdate) >= 1995 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS o_totalprice,
               CASE WHEN year(o_orderdate) <= 1996 THEN o_orderpriority END AS o_orderpriority FROM orders""",
    "bucket_upsert": """
        SELECT o_orderkey, round(CASE WHEN year(o_orderdate) >= 1995 THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS o_totalprice,
               CASE WHEN year(o_orderdate) <= 1996 THEN o_orderpriority END AS o_orderpriority FROM orders""",
    "mark_scan": "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-20'",
    "feed_pages": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "counter_merge": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "partial_update": """
        SELECT p_partkey, p_brand, p_size + CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem
               WHERE l_quantity >= 50 AND l_suppkey < 3) THEN 100 ELSE 0 END AS p_size FROM part""",
    "refresh_records": """
        WITH o AS (SELECT doc_id, CASE WHEN n_chars >= 400 THEN text END AS title FROM documents WHERE coalesce(lang, '') <> 'de'),
        s AS (SELECT doc_id, text AS t FROM documents WHERE coalesce(lang, '') <> 'fr'),
        j AS (SELECT coalesce(o.doc_id, s.doc_id) AS doc_id, title, t, o.doc_id IS NOT NULL AS known,
                     t IS NOT NULL AS hit, title IS NULL OR title = '' AS fresh FROM o FULL JOIN s ON o.doc_id = s.doc_id)
        SELECT doc_id, coalesce(t, title) AS title, CASE WHEN hit AND fresh THEN TIMESTAMP '2024-01-01' END AS created_time,
               CASE WHEN hit AND NOT fresh THEN TIMESTAMP '2024-01-01' END AS refresh_time, hit AND NOT fresh AS refreshed,
               known AND NOT (hit AND NOT fresh) AS uploaded FROM j""",
    "delete_keys": """
        SELECT o_orderkey, o_orderstatus FROM orders
        WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "insert_absent": "SELECT c_custkey, c_nationkey FROM customer",
    "unbind_items": "SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN -1 ELSE c_nationkey END AS c_nationkey FROM customer",
    "keep_curated": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 AND o_orderpriority IN ('5-LOW', '4-NOT SPECIFIED')
               THEN '9-NEW' ELSE o_orderpriority END AS o_orderpriority FROM orders""",
    "claim_head": """
        SELECT o_orderkey, CASE WHEN o_orderkey = (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'
               ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1) THEN 'C' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
    "latest_per_key": """
        SELECT user_id, ts, event_id, event_type, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "id_allocate": "SELECT p_partkey, p_name, 1000 + row_number() OVER (ORDER BY p_partkey) AS group_id FROM part",
    "tree_rollup": f"""{_CLOSURE}, n AS (SELECT 'c' || o_custkey AS node, count(*) AS a, count(*) FILTER (WHERE o_totalprice > 300000) AS b
            FROM orders GROUP BY o_custkey)
        SELECT ancestor AS node, CAST(coalesce(sum(a), 0) AS BIGINT) AS item_num, CAST(coalesce(sum(b), 0) AS BIGINT) AS selection_num
        FROM up LEFT JOIN n ON n.node = up.node GROUP BY ancestor""",
    "tree_path": f"""{_CLOSURE}
        SELECT up.node, string_agg(e.name, ' > ' ORDER BY distance DESC) AS path FROM up JOIN e ON e.node = up.ancestor GROUP BY up.node""",
    "tree_descendants": f"{_CLOSURE} SELECT node, distance FROM up WHERE ancestor = 'r2' AND distance > 0",
    "full_refresh": """
        WITH r AS (SELECT *, CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS INTEGER) AS m FROM region),
        n AS (SELECT *, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS k FROM nation)
        SELECT 10 + m AS id, 0 AS parent, r_name AS name FROM r
        UNION ALL SELECT 100 + 10 * k + m, 10 + m, n_name FROM n JOIN r ON n_regionkey = r_regionkey""",
    "prop_pairs": "SELECT p_partkey, 2 AS n_props, p_brand AS brand, p_type AS size FROM part",
    "json_fields": """
        SELECT CAST(props ->> '$.k' AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1""",
    "brand_counts_merge": """
        WITH o AS (SELECT p_brand, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand),
        f AS (SELECT p_brand, count(*) AS f FROM part WHERE p_partkey % 2 = 1 GROUP BY p_brand)
        SELECT p_brand, n + f AS freq, round((n + f) / (n / (n / (SELECT sum(n) FROM o)) + (SELECT sum(f) FROM f)), 8) AS prob
        FROM o JOIN f USING (p_brand)""",
    "prop_counts": """
        WITH q AS (SELECT CAST(p_size AS VARCHAR) AS v, '1' AS p, p_type FROM part
                   UNION ALL SELECT p_brand, '2', p_type FROM part
                   UNION ALL SELECT '9', '1', p_type FROM part)
        SELECT kind, key, category, CAST(n AS BIGINT) AS n FROM (
          SELECT 'prop' AS kind, p AS key, CAST(NULL AS VARCHAR) AS category, count(*) AS n FROM q GROUP BY p
          UNION ALL SELECT 'value', v, NULL, count(*) FROM q WHERE v IS NOT NULL GROUP BY v
          UNION ALL SELECT 'prop_category', p, p_type, count(*) FROM q GROUP BY p, p_type) t""",
}
