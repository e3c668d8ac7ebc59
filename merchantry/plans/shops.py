"""Shop queries: suppliers stand for shops, order lines for their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchantry.operators import score
from merchantry.sources.tables import table


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_quantity").cast("long").alias("likes"), (F.col("l_quantity") > 45).alias("selected")
    )
    return score.shop_totals(table(spark, sf, "supplier"), lines, "s_suppkey", "l_suppkey", "likes", F.col("selected"))


def shop_score(spark: SparkSession, sf: str) -> DataFrame:
    likes, selections = F.col("total_likes"), F.col("total_selections")
    return (
        _totals(spark, sf)
        .withColumn("score", F.round(score.shop_score(likes, selections), 6))
        .orderBy(F.desc("score"), "s_suppkey")
    )


def shop_priority(spark: SparkSession, sf: str) -> DataFrame:
    args = F.col("total_likes"), F.col("total_selections"), F.col("total_items")
    return _totals(spark, sf).select("s_suppkey", "total_items", score.shop_priority(*args).alias("priority"))


def item_score(spark: SparkSession, sf: str) -> DataFrame:
    """Items of a line table scored with their shop's score; the shop side is one row a shop."""
    shops = _totals(spark, sf).select(
        "s_suppkey", score.shop_score(F.col("total_likes"), F.col("total_selections")).alias("shop")
    )
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    likes = F.col("l_quantity").cast("long")
    scored = score.item_score(likes, F.col("l_quantity") > 45, F.col("shop"))
    return items.join(shops, items.l_suppkey == shops.s_suppkey).select(
        "l_orderkey", "l_linenumber", F.round(scored, 4).alias("score")
    )


_TOTALS = """
    SELECT s_suppkey, CAST(coalesce(sum(CAST(floor(l_quantity) AS BIGINT)), 0) AS BIGINT) AS total_likes,
           CAST(count(*) FILTER (WHERE l_quantity > 45) AS BIGINT) AS total_selections,
           count(l_orderkey) AS total_items
    FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_suppkey"""
_SCORE = "ln(1 + total_likes + 20 * total_selections + (10 * total_likes) // (1 + total_selections))"

QUERIES = {"shop_score": shop_score, "shop_priority": shop_priority, "item_score": item_score}
SQL = {
    "shop_score": f"SELECT *, round({_SCORE}, 6) AS score FROM ({_TOTALS}) t",
    "shop_priority": f"""
        SELECT s_suppkey, total_items, CAST(CASE WHEN total_selections >= 100 THEN 5
            WHEN total_selections >= 20 AND total_likes // nullif(total_items, 0) >= 200 THEN 6
            WHEN total_selections >= 30 THEN 7 WHEN total_likes >= 3000 THEN 8
            WHEN total_selections >= 5 THEN 9 ELSE 10 END AS INTEGER) AS priority FROM ({_TOTALS}) t""",
    "item_score": f"""
        SELECT l_orderkey, l_linenumber, round((1 + pow(ln(
            10 * CAST(floor(l_quantity) AS BIGINT) * CASE WHEN l_quantity > 45 THEN 1.1e0 ELSE 1.0e0 END + 1), 2))
            * (1 + {_SCORE}), 4) AS score
        FROM lineitem JOIN ({_TOTALS}) t ON l_suppkey = s_suppkey""",
}
