"""Scores and priorities of shops and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shop_totals(shops: DataFrame, items: DataFrame, shop_key: str, item_shop: str, likes: str, selected: Column) -> DataFrame:
    """Per shop: total_likes, total_selections, total_items; shops without items count zero.

    Items are pre-aggregated before the join, so the join moves one row a shop.
    """
    per_shop = items.groupBy(F.col(item_shop).alias(shop_key)).agg(
        F.coalesce(F.sum(likes), F.lit(0)).cast("long").alias("total_likes"),
        F.count_if(selected).alias("total_selections"),
        F.count(F.lit(1)).alias("total_items"),
    )
    zero = {name: 0 for name in ("total_likes", "total_selections", "total_items")}
    return shops.select(shop_key).join(per_shop, shop_key, "left").fillna(zero)


def shop_score(likes: Column, selections: Column) -> Column:
    """ln(1 + L + 20 S + 10 L div (1 + S)) with integer division."""
    ratio = F.call_function("div", 10 * likes, 1 + selections)
    return F.log(1 + likes + 20 * selections + ratio)


def item_score(likes: Column, selected: Column, shop: Column) -> Column:
    """(1 + ln(s + 1)^2) (1 + shop), s being ten times the likes, a tenth more for selected items."""
    s = 10 * likes * F.when(selected, F.lit(1.1)).otherwise(F.lit(1.0))
    return (1 + F.pow(F.log(s + 1), F.lit(2.0))) * (1 + shop)


def shop_priority(likes: Column, selections: Column, items: Column) -> Column:
    """5 (most urgent) to 10; a shop without items has no likes per item."""
    per_item = F.coalesce(F.call_function("div", likes, F.nullif(items, F.lit(0).cast("long"))), F.lit(0))
    return (
        F.when(selections >= 100, 5)
        .when((selections >= 20) & (per_item >= 200), 6)
        .when(selections >= 30, 7)
        .when(likes >= 3000, 8)
        .when(selections >= 5, 9)
        .otherwise(10)
    )
