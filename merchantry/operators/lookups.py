"""Lookup loops as set joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchantry.functions.numbers import price_difference


def collected(parents: DataFrame, children: DataFrame, key: str, child_key: str, value: str, name: str) -> DataFrame:
    """Each parent with its children's values in order, joined by commas; empty where it has none."""
    lists = children.groupBy(F.col(child_key).alias(key)).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.lit("")))


def flags(all_rows: DataFrame, held: DataFrame, key: str, name: str) -> DataFrame:
    """All rows with whether each is held."""
    marks = held.select(key).distinct().withColumn(name, F.lit(True))
    return all_rows.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def option_flags(options: Sequence[str], held: Column) -> Column:
    """Fixed options with on or off for a held array."""
    on = lambda o: F.coalesce(F.array_contains(held, o), F.lit(False))
    return F.transform(F.array(*(F.lit(o) for o in options)), lambda o: F.struct(o.alias("option"), on(o).alias("on")))


def bulk_status(ids: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Each requested id with `found` or `error` and its value."""
    found = table.select(F.col(key), F.col(value), F.lit(True).alias("_found"))
    status = F.when(F.col("_found"), "found").otherwise("error").alias("status")
    return ids.join(found, key, "left").select(key, status, value)


def price_band(items: DataFrame, groups: DataFrame, category: str, item_price: str, group_price: str, most: float) -> DataFrame:
    """Items with the groups of their category whose price differs by at most `most`.

    The residual test runs inside the equi-join. So that a large category is not compared whole, both sides are dealt
    into bands of the logarithm of the price; prices within the limit are in the same or a neighbouring band.
    """
    import math

    width = -math.log(1 - most)
    band = lambda c: F.floor(F.log(F.greatest(F.col(c).cast("double"), F.lit(1e-9))) / F.lit(width + 1e-9))
    left = items.withColumn("_band", band(item_price))
    right = groups.withColumn("_band", F.explode(F.array(*(band(group_price) + d for d in (-1, 0, 1)))))
    joined = left.join(right, [category, "_band"]).drop("_band")
    return joined.where(price_difference(F.col(item_price), F.col(group_price)) <= most)


def fallback(rows: DataFrame, table: DataFrame, key: str, value: str, otherwise: Column, name: str) -> DataFrame:
    """A looked-up value, or another where the key is unknown."""
    return rows.join(table.select(key, F.col(value).alias("_v")), key, "left").withColumn(name, F.coalesce("_v", otherwise)).drop("_v")
