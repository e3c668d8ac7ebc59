"""Mixing sources to target weights by systematic sampling (1). DataFrame functions only.

Sources in code point order, null last, have weights that repeat a cycle. They share `share` times all words; a target
stops at `most` times its source's words and the excess goes to the others by weight, which is a water level: target =
min(cap, level * weight). A document's expected copies are target / source words. In each source the documents, long ones
first, stand on a line where each takes its expected copies; one offset a source, hashed from seed and name, shifts the
line, and a document is emitted once for each whole number it crosses. No document is emitted over ceil(most) times.

Ranks on the line need no task that sees a whole source. Documents are counted by (source, size) and by (source, size,
slice of ids); two windows over those counts, and one over the documents of a slice, add up to a document's rank.

Defined results: a null text has size 0; a source without words has target 0 and its documents are taken 0 times; rows
with equal id and size are interchangeable and each counts; null ids come last within their size; other columns are
ignored by plan().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.llm.learning import free
from merchantry.session import cut


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _before(window: object) -> object:
    return window.rowsBetween(Window.unboundedPreceding, -1)


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """skey, source_size -> also weight and target. One row a source: a few, so one task ranks them."""
    order = Window.orderBy("skey")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sources.withColumn("weight", F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    total = Window.partitionBy()
    goal = F.lit(float(share)) * F.sum("source_size").over(total)
    # The level if just the sources before this one were full; the true level is the greatest.
    level = (goal - F.coalesce(F.sum("cap").over(_before(by_need)), F.lit(0.0))) / (
        F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(_before(by_need)), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level)
    target = F.least("cap", F.max("level").over(total) * F.col("weight"))
    return ranked.select("skey", "source_size", "weight", target.alias("target"))


def offset(skey: Column, seed: str, number: Column) -> Column:
    """A number in [0, 1) from seed, number and source."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), number.cast("string"), skey).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(4294967296.0)


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", slices: int = 64, offsets: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken and copies for each row of docs."""
    source = F.col(source_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("skey"),
        word_count(F.col(text_col)).alias("size"),
    )
    rows = cut(rows.withColumn("slice", F.coalesce(F.pmod("doc_id", F.lit(slices)), F.lit(0)).cast("int")))
    slice_counts = rows.groupBy("skey", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    size_counts = rows.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
    sources = size_counts.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"))
    longer = F.coalesce(F.sum("n").over(_before(Window.partitionBy("skey").orderBy(F.desc("size")))), F.lit(0))
    sizes = size_counts.select("skey", "size", longer.alias("longer")).join(targets(sources, weights, share, most), "skey")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.nullif("source_size", F.lit(0))).otherwise(0.0)
    sizes = sizes.withColumn("rate", rate)
    at = lambda rank: F.floor(rank * F.col("rate") + F.col("offset"))
    trials = sizes.join(size_counts, ["skey", "size"]).withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))))
    trials = trials.withColumn("offset", offset(F.col("skey"), seed, F.col("number")))
    crossed = at(F.col("longer") + F.col("n")) - at(F.col("longer"))
    totals = trials.groupBy("skey", "target", "number", "offset").agg(F.sum(crossed * F.col("size")).alias("total"))
    nearest = F.struct(F.abs(F.col("total") - F.col("target")), "number")
    sizes = sizes.join(totals.groupBy("skey").agg(F.min_by("offset", nearest).alias("offset")), "skey")
    earlier = F.coalesce(F.sum("n").over(_before(Window.partitionBy("skey", "size").orderBy("slice"))), F.lit(0))
    starts = slice_counts.select("skey", "size", "slice", earlier.alias("earlier")).join(sizes, ["skey", "size"])
    within = Window.partitionBy("skey", "size", "slice").orderBy(F.col("doc_id").asc_nulls_last())
    ranked = rows.withColumn("rank", F.row_number().over(within)).join(starts, ["skey", "size", "slice"])
    last = F.col("longer") + F.col("earlier") + F.col("rank")
    out = ranked.withColumn("copies", (at(last) - at(last - 1)).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def sample(docs: DataFrame, id_col: str = "doc_id", **options: object) -> DataFrame:
    """The rows of docs as often as plan() takes them, numbered by `copy_no` from 1 (copy_no_ and so on, where docs has a
    column of that name, which passes through). Rows that share an id and a size are taken by the largest count among
    them."""
    text_col = options.get("text_col", "text")
    taken = plan(docs, id_col=id_col, **options).groupBy("doc_id", "size").agg(F.max("copies").alias("copies"))
    taken = taken.where("copies > 0").withColumn("copies", F.sequence(F.lit(1), F.col("copies").cast("int")))
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    of = dict(zip(docs.columns, names, strict=True))
    same = F.col(of[id_col]).cast("long").eqNullSafe(F.col("doc_id")) & (word_count(F.col(of[text_col])) == F.col("size"))
    out = docs.toDF(*names).join(taken, same).select(*names, F.explode("copies").alias("copy_no"))
    return out.toDF(*docs.columns, free("copy_no", docs.columns))
