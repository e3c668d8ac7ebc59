"""Browsing, queues, pages and lookups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.functions import numbers
from merchantry.operators import lookups, paging, predicates
from merchantry.sources.tables import table

AS_OF = dt.datetime(2001, 8, 2)


def queue_head(spark: SparkSession, sf: str) -> DataFrame:
    order = ["o_orderpriority", "o_orderdate", "o_orderkey"]
    return paging.head_of_queue(table(spark, sf, "orders"), F.col("o_orderstatus") == "O", order).select("o_orderkey", "o_orderpriority", "o_orderdate")


def watermark_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return paging.after_mark(rows, "o_orderdate", "o_orderkey", (dt.datetime(1998, 1, 1), 100), 500)


def backlog_unset(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return paging.backlog(rows, predicates.missing(F.col("quality")), [F.desc("n_chars"), "doc_id"], 200).select("doc_id", "lang", "n_chars")


def regex_search(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").where(predicates.matches(F.col("p_name"), "RED|^Old"))
    return parts.select("p_partkey", "p_name").orderBy(F.desc("p_partkey"))


def browse_parts(spark: SparkSession, sf: str) -> DataFrame:
    """A browse page with a name search, a brand and a size, and the sort that the request names."""
    columns = {c: F.col(c) for c in ("p_name", "p_brand", "p_size")}
    rows = table(spark, sf, "part").where(predicates.browse({"p_name": "ring", "p_brand": "", "p_size": 11}, columns))
    return paging.page(rows.select("p_partkey", "p_name", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], 1, 50)


def paged_browse(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return paging.page(rows, [F.desc("p_retailprice"), "p_partkey"], 3, 50)


def page_info(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").where(F.col("p_retailprice") > 950).agg(F.count(F.lit(1)).alias("total"))
    return rows.select("total", *paging.page_info(F.col("total"), 3, 50))


def matched_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Items of matched categories with a name; the category side is planned by its size."""
    cats = table(spark, sf, "nation").where(F.col("n_regionkey") == 1)
    items = table(spark, sf, "customer").where(~predicates.blank(F.col("c_name")))
    return items.join(cats, items.c_nationkey == cats.n_nationkey).select("c_custkey", "c_name", "n_name")


def left_collect(spark: SparkSession, sf: str) -> DataFrame:
    return lookups.collected(table(spark, sf, "region"), table(spark, sf, "nation"), "r_regionkey", "n_regionkey", "n_name", "nations")


def flag_holders(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer")
    held = customers.where(F.col("c_nationkey") == 3).select(F.col("c_mktsegment").alias("segment"))
    every = customers.select(F.col("c_mktsegment").alias("segment")).distinct()
    return lookups.flags(every, held.where(F.col("segment") != "BUILDING"), "segment", "held")


def option_flags(spark: SparkSession, sf: str) -> DataFrame:
    held = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("held"))
    rows = held.select("o_custkey", F.explode(lookups.option_flags(["O", "F", "P"], F.col("held"))).alias("f"))
    return rows.select("o_custkey", F.col("f.option").alias("status_option"), F.col("f.on").alias("is_on"))


def level_default(spark: SparkSession, sf: str) -> DataFrame:
    levels = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("level"))
    rows = table(spark, sf, "customer").join(levels, "c_custkey", "left")
    level = F.coalesce("level", F.lit(0))
    return rows.select("c_custkey", level.alias("level"), predicates.level_at_least(F.col("level"), 10).alias("allowed"))


def semi_in_list(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


def anti_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an urgent order."""
    orders = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey", "c_name")


def price_band_join(spark: SparkSession, sf: str) -> DataFrame:
    """All parts with the groups of their brand (one a size, all parts in them) whose mean price is within 30 %."""
    items = table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    groups = table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("group_id"), F.round(F.avg("p_retailprice"), 4).alias("group_price")).drop("p_size")
    joined = lookups.price_band(items, groups, "p_brand", "p_retailprice", "group_price", 0.3)
    return joined.select("p_partkey", "group_id", F.round(numbers.price_difference(F.col("p_retailprice"), F.col("group_price")), 6).alias("difference"))


def bulk_read(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("c_custkey")).distinct()
    return lookups.bulk_status(ids, table(spark, sf, "customer"), "c_custkey", "c_name")


def lookup_fallback(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "labels").select("doc_id", "quality").dropDuplicates(["doc_id"])
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    return lookups.fallback(rows, known, "doc_id", "quality", F.when(F.col("lang") == "en", 1).otherwise(0), "state").select("doc_id", "state")


def age_requeue(spark: SparkSession, sf: str) -> DataFrame:
    """Order status stands for finished (F), crawling (P) and queued (O), priority for the cycle in hours."""
    from merchantry.operators.merge import next_states

    state = F.create_map(*map(F.lit, ("F", "finished", "P", "crawling", "O", "queued")))[F.col("o_orderstatus")]
    cycle = F.substring("o_orderpriority", 1, 1).cast("int") * 8760
    rows = table(spark, sf, "orders").select("o_orderkey", state.alias("state"), next_states(state, F.col("o_orderdate"), F.lit(AS_OF), cycle, 72.0).alias("next_state"))
    return rows


def any_of_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").where(
        predicates.any_of([F.col("o_orderstatus") == "F", F.col("o_totalprice") > 400000], [predicates.not_true(F.col("o_orderpriority") != "1-URGENT"), predicates.since(F.col("o_orderdate"), dt.datetime(2001, 1, 1))])
    )
    return rows.select("o_orderkey", "o_totalprice")


def grouped_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Filtered counts by day part and event type."""
    events = table(spark, sf, "events")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 10).alias("n_large"), F.round(F.sum("value"), 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        queue_head, watermark_scan, backlog_unset, regex_search, browse_parts, paged_browse, page_info, matched_categories,
        left_collect, flag_holders, option_flags, level_default, semi_in_list, anti_absent, price_band_join, bulk_read,
        lookup_fallback, age_requeue, any_of_states, grouped_rates,
    )
}

SQL = {
    "queue_head": "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY 2, 3, 1 LIMIT 1",
    "watermark_scan": """
        SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
        WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1998-01-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 500""",
    "backlog_unset": """
        SELECT d.doc_id, lang, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NULL
        ORDER BY n_chars DESC, d.doc_id LIMIT 200""",
    "regex_search": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RED|^Old')",
    "browse_parts": """
        SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_name ILIKE '%ring%' AND p_size = 11
        ORDER BY p_retailprice DESC, p_partkey LIMIT 50""",
    "paged_browse": "SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 100",
    "page_info": """
        SELECT total, CAST(ceil(total / 50.0) AS BIGINT) AS pages, CAST(2 AS BIGINT) AS previous,
               CAST(CASE WHEN 3 < ceil(total / 50.0) THEN 4 ELSE 0 END AS BIGINT) AS next
        FROM (SELECT count(*) AS total FROM part WHERE p_retailprice > 950) t""",
    "matched_categories": """
        SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE n_regionkey = 1 AND c_name <> ''""",
    "left_collect": """
        SELECT r_regionkey, r_name, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS nations
        FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL""",
    "flag_holders": """
        SELECT DISTINCT c_mktsegment AS segment, c_mktsegment IN (SELECT c_mktsegment FROM customer
            WHERE c_nationkey = 3 AND c_mktsegment <> 'BUILDING') AS held FROM customer""",
    "option_flags": """
        SELECT o_custkey, o.option AS status_option, bool_or(o_orderstatus = o.option) AS is_on
        FROM orders, (VALUES ('O'), ('F'), ('P')) AS o(option) GROUP BY ALL""",
    "level_default": """
        SELECT c_custkey, count(o_orderkey) AS level, count(o_orderkey) >= 10 AS allowed
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
    "semi_in_list": """
        SELECT c_custkey, c_name FROM customer
        WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "anti_absent": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "price_band_join": """
        WITH g AS (SELECT p_brand, min(p_partkey) AS group_id, round(avg(p_retailprice), 4) AS price FROM part GROUP BY p_brand, p_size)
        SELECT p_partkey, group_id, round(1 - least(p_retailprice, price) / greatest(p_retailprice, price), 6) AS difference
        FROM part JOIN g USING (p_brand) WHERE 1 - least(p_retailprice, price) / greatest(p_retailprice, price) <= 0.3""",
    "bulk_read": """
        SELECT i.c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'error' ELSE 'found' END AS status, c_name
        FROM (SELECT DISTINCT o_custkey * 2 AS c_custkey FROM orders) i LEFT JOIN customer c ON i.c_custkey = c.c_custkey""",
    "lookup_fallback": """
        SELECT d.doc_id, coalesce(quality, CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS state
        FROM documents d LEFT JOIN (SELECT DISTINCT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id""",
    "age_requeue": """
        SELECT o_orderkey, s AS state, CASE WHEN s = 'finished'
                 AND epoch_us(TIMESTAMP '2001-08-02') - epoch_us(o_orderdate) > 8760 * 3600000000 * CAST(o_orderpriority[1] AS BIGINT) THEN 'queued'
               WHEN s = 'crawling' AND epoch_us(TIMESTAMP '2001-08-02') - epoch_us(o_orderdate) > 72 * 3600000000 THEN 'queued'
               ELSE s END AS next_state
        FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'crawling' ELSE 'queued' END AS s FROM orders) t""",
    "any_of_states": """
        SELECT o_orderkey, o_totalprice FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 400000)
            OR (o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2001-01-01')""",
    "grouped_rates": """
        SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 10) AS n_large, round(sum(value), 4) AS total
        FROM events GROUP BY event_type""",
}
