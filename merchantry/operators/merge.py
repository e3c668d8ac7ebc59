"""Mutations as rewrites: a table and its changes give a new table.

Parquet tables have no MERGE, so each function returns the whole new content, to be written to a new folder;
operators.bucketed applies them to the buckets that a batch touches. One full outer join by key carries updates and
insertions together. A table has one row a key and keeps it so: where changes name a key several times, they count as
applied one after another, in the order that is given, or else in the order of their values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order (K17). Aggregates before the shuffle, so a hot key is one row from
    each task."""
    others = [c for c in rows.columns if c not in key]
    # max_by over a struct keeps one candidate a task and key; a window would move every row.
    ranked = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return ranked.select(*key, "_row.*").select(rows.columns)


def _mark(*tables: DataFrame) -> str:
    """Underscores that make a name which no column of the tables has."""
    return "_" * (1 + max(len(c) for t in tables for c in [*t.columns, ""]))


def _order(changes: DataFrame, key: str, order: Sequence[Column]) -> Column:
    return F.struct(*(order or [F.col(c) for c in changes.columns if c != key] or [F.col(key)]))


def _last_rows(changes: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The last change of each key, whole."""
    others = [c for c in changes.columns if c != key]
    ranked = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), _order(changes, key, order)).alias(_mark(changes)))
    return ranked.select(key, f"{_mark(changes)}.*")


def upsert(table: DataFrame, changes: DataFrame, key: str, order: Sequence[Column] = ()) -> DataFrame:
    """Rows of changes replace those of table column by column where they are not null, or are inserted (K02, K22). Of the
    changes of a key each column takes its last value that is not null. Changes without a key are left out."""
    mark, by = _mark(table, changes), _order(changes, key, order)
    others = [c for c in changes.columns if c != key]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(mark + c) for c in others] or [F.count(F.lit(1)).alias(mark)]
    new = changes.where(F.col(key).isNotNull()).groupBy(key).agg(*last)
    joined = table.join(new, key, "full_outer")
    values = [F.coalesce(mark + c, c).alias(c) if c in others else F.col(c) for c in table.columns if c != key]
    return joined.select(key, *values).select(table.columns)


def set_where(table: DataFrame, keys: DataFrame, key: str, values: Mapping[str, Column]) -> DataFrame:
    """Partial update of the rows whose key is listed."""
    mark = _mark(table)
    hit = keys.select(key).distinct().withColumn(mark, F.lit(True))
    joined = table.join(hit, key, "left")
    return joined.select(*(F.when(F.col(mark), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns))


def add_counts(totals: DataFrame, rows: DataFrame, key: str, count: str) -> DataFrame:
    """Totals with the counts of new rows added (K04, A02): rows are counted before the join."""
    mark = _mark(totals)
    new = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(mark))
    joined = totals.join(new, key, "full_outer")
    return joined.select(key, (F.coalesce(count, F.lit(0)) + F.coalesce(mark, F.lit(0))).cast("long").alias(count))


def insert_or_refresh(table: DataFrame, seen: DataFrame, key: str, as_of: Column, filled: str = "title", order: Sequence[Column] = ()) -> DataFrame:
    """Columns by branch (K06): a row without a title yet is created at as_of, one that has it is marked as refreshed
    and not uploaded. table: key, title, created_time, refresh_time, refreshed, uploaded; seen: key, title."""
    new = _last_rows(seen.select(key, filled) if not order else seen, key, order).select(key, F.col(filled).alias("_title"))
    joined = table.join(new, key, "full_outer")
    hit, fresh = F.col("_title").isNotNull(), F.col(filled).isNull() | (F.col(filled) == "")
    return joined.select(
        key,
        F.coalesce("_title", filled).alias(filled),
        F.when(hit & fresh, as_of).otherwise(F.col("created_time")).alias("created_time"),
        F.when(hit & ~fresh, as_of).otherwise(F.col("refresh_time")).alias("refresh_time"),
        F.when(hit & ~fresh, True).otherwise(F.coalesce("refreshed", F.lit(False))).alias("refreshed"),
        F.when(hit & ~fresh, False).otherwise(F.coalesce("uploaded", F.lit(False))).alias("uploaded"),
    )


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """K07."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the table yet, once each."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti"))


def unbind(table: DataFrame, owner: str, old: object) -> DataFrame:
    """Rows owned by `old` have no owner (-1)."""
    return table.withColumn(owner, F.when(F.col(owner) == F.lit(old), F.lit(-1)).otherwise(F.col(owner)))


def keep_curated(table: DataFrame, changes: DataFrame, key: str, column: str, uncurated: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """A value set by hand stays; only the listed ones, or none, are overwritten (K19, K21, K25). Of the changes of a key
    the first one that is not itself a listed value is the last that takes effect."""
    mark, by, value = _mark(table, changes), _order(changes, key, order), F.col(column)
    curated = F.min_by(value, F.when(value.isNotNull() & ~value.isin(*uncurated), by))
    new = changes.groupBy(key).agg(F.coalesce(curated, F.max_by(value, F.when(value.isNotNull(), by))).alias(mark))
    joined, open_ = table.join(new, key, "left"), value.isNull() | value.isin(*uncurated)
    return joined.select(*(F.when(open_, F.coalesce(mark, column)).otherwise(value).alias(c) if c == column else F.col(c) for c in table.columns))


def set_all(table: DataFrame, values: Mapping[str, Column]) -> DataFrame:
    """Every row updated."""
    return table.withColumns(dict(values))


def replaced_structs(table: DataFrame, changes: DataFrame, key: str, structs: Sequence[str], stamps: Mapping[str, Column], order: Sequence[Column] = ()) -> DataFrame:
    """Whole nested structs replaced, a null one included, and times stamped, for the keys that changes name."""
    mark = _mark(table, changes)
    new = _last_rows(changes, key, order).select(F.col(key), *(F.col(c).alias(mark + c) for c in structs), F.lit(True).alias(mark))
    joined, hit = table.join(new, key, "left"), F.col(mark)
    value = lambda c: F.when(hit, F.col(mark + c)).otherwise(F.col(c)) if c in structs else F.when(hit, stamps[c]).otherwise(F.col(c))
    return joined.select(*(value(c).alias(c) if c in structs or c in stamps else F.col(c) for c in table.columns))


def refreshed_shops(table: DataFrame, fetched: DataFrame, key: str, keep: Sequence[str], kind: str, ruling: str, order: Sequence[Column] = ()) -> DataFrame:
    """Shops as fetched anew, but for the columns of keep; the kind `ruling` stays; shops that are gone leave.
    fetched: key, gone, and columns of table; shops that were not fetched stay as they are."""
    mark, others = _mark(table, fetched), [c for c in fetched.columns if c not in (key, "gone")]
    last = _last_rows(fetched, key, order)
    new = last.select(F.col(key), F.col("gone").alias(f"{mark}gone"), *(F.col(c).alias(mark + c) for c in others), F.lit(True).alias(mark))
    joined, hit = table.join(new, key, "left").where(~F.coalesce(f"{mark}gone", F.lit(False))), F.col(mark).isNotNull()
    changed = lambda c: F.when(hit & (F.lit(c != kind) | (F.col(kind) != ruling)), F.col(mark + c)).otherwise(F.col(c))
    return joined.select(*(changed(c).alias(c) if c in others and c not in keep else F.col(c) for c in table.columns))


def with_children(table: DataFrame, rows: DataFrame, trimmed: Sequence[str], as_of: Column) -> DataFrame:
    """Child rows appended, named texts trimmed and both times set."""
    new = rows.withColumns({c: F.trim(c) for c in trimmed}).withColumns({"created_time": as_of, "updated_time": as_of})
    return table.unionByName(new)


def recrawled(parsed: DataFrame, failed: DataFrame, shops: DataFrame, key: str, shop: str, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a new crawl leaves (K24): records of pages that parsed, the failed table with pages that did not, and shops
    with those seen for the first time, queued. parsed: key, shop, error, record; failed: key; shops: shop, status,
    created_time."""
    good = parsed.where("error is null")
    left = failed.join(good.select(key), key, "left_anti").unionByName(parsed.where("error is not null").select(key)).distinct()
    new = good.where(F.col(shop).isNotNull()).select(shop).distinct().select(shop, F.lit("queued").alias("status"), as_of.alias("created_time"))
    return good.select(key, shop, "record.*"), left, insert_absent(shops, new, shop)


def claim(table: DataFrame, key: str, state: str, order: Sequence[Column], queued: str, taken: str) -> DataFrame:
    """The head of the queue is taken (K09): one row changes its state."""
    head = table.where(F.col(state) == queued).orderBy(*order).limit(1).select(F.col(key).alias("_key"))
    joined = table.join(F.broadcast(head), F.col(key) == F.col("_key"), "left")  # the build side is one row
    value = F.when(F.col("_key").isNotNull(), taken).otherwise(F.col(state))
    return joined.select(*(value.alias(c) if c == state else F.col(c) for c in table.columns))


def next_states(state: Column, last: Column, as_of: Column, cycle_hours: Column, stale_hours: float) -> Column:
    """finished becomes queued after its cycle, crawling becomes queued when stale."""
    from merchantry.operators.predicates import older_than

    return (
        F.when((state == "finished") & older_than(last, as_of, cycle_hours), "queued")
        .when((state == "crawling") & older_than(last, as_of, stale_hours), "queued")
        .otherwise(state)
    )

