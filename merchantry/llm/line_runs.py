"""Line dedup by a suffix array over line-ID sequences (9).

A document is the sequence of its lines that have a word. A run of lines that stands at an earlier place too (a smaller
doc_id, or further up in the same document) and has `min_words` words or more is a later copy; all lines of later copies
are deleted. Lines are equal when their 128-bit BLAKE2b digests are; no weaker hash stands for a line.

All documents, in order, are one sequence of lines, and a place in it is one number. Prefix doubling ranks the suffixes
by their first 1, 2, 4, ... lines: the rank for 2^(k+1) lines comes from sorting pairs, the rank at a place and the rank
2^k places on. A rank is the number of suffixes before it, so that suffixes of one rank are an interval of the suffix
array, and its longest common prefix has 2^k lines or more. Pairs are counted, and only pairs found twice or more are
sorted, by ranges: a suffix whose pair is alone has no longer run in common with any other and leaves the array, and so
does one whose document ends. Rounds go on until no interval is left, log2 of the longest repeated run.

In an interval all places but the first begin a later copy. A maximal repeated run of a document is the union of the
later copies that overlap, as a run of any length is covered by runs of the largest power of two within it; one pass over
a document's places, keeping the furthest end so far, finds the lines of these unions. Near the bound of words a run may
have enough words only in a length between two powers. Each line of such a run lies in one of two shortest runs with
enough words, the one that ends with it or the one that the copy begins with. These have at most `min_words` lines and
are compared by the ranks at their two ends.

Defined results: a null text stays null and has no lines; lines without words are neither compared nor deleted; rows
that agree in id and text are one document and get the same result; other rows with one id are ordered by the hash of
their text; null ids come first; other columns pass through delete_runs(); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from merchantry.llm import vectors
from merchantry.llm.learning import free
from merchantry.session import cut, ship_package

_LINES = "doc_id long, text_hash long, pos int, line_no int, line long, line_b long, fwd int, back int"
_DOCUMENT = ["has_id", "doc_id", "text_hash"]


def shortest_runs(words: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the shortest runs with `least` words that begin and that end with each line; 0 where there is none."""
    sums = np.concatenate([[0], np.cumsum(words)])
    place = np.arange(len(words))
    end = np.searchsorted(sums, sums[:-1] + least, "left")
    fits = (end <= len(words)) & (text[np.minimum(end, len(words)) - 1] == text)
    begin = np.searchsorted(sums, sums[1:] - least, "right") - 1
    holds = (begin >= 0) & (text[np.maximum(begin, 0)] == text)
    return np.where(fits, end - place, 0), np.where(holds, place + 1 - begin, 0)


def _lines(least: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in vectors.pieces(batch.column(1)):
                data, offsets = piece.data, piece.offsets
                starts, ends = vectors.edges(data != 10, offsets)
                text = np.searchsorted(offsets, starts, "right") - 1
                breaks = np.concatenate([[0], np.cumsum(data == 10)])
                line_no = breaks[starts] - breaks[offsets[text]]
                word_starts, _ = vectors.edges(~vectors._SPACE[data], offsets)
                words = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
                has = words > 0
                starts, ends, text, line_no, words = (x[has] for x in (starts, ends, text, line_no, words))
                count = np.bincount(text, minlength=piece.n)
                pos = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
                fwd, back = shortest_runs(words, text, least)
                line = vectors.digests(data, starts, ends).view(np.int64)
                rows = pa.array(piece.first + text)
                small = lambda x: pa.array(x.astype(np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), small(pos), small(line_no), pa.array(line[:, 0]), pa.array(line[:, 1]), small(fwd), small(back)],
                    names=["doc_id", "text_hash", "pos", "line_no", "line", "line_b", "fwd", "back"],
                )

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        sums = total + np.cumsum(n)
        names = [*batch.schema.names, "part", "before"]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(sums - n)], names=names)
        total = int(sums[-1]) if len(n) else total


def _in_order(rows: DataFrame, key: list[str]) -> DataFrame:
    """rows with `before`, the sum of n over all rows with a smaller key. Keys are unique; ranges of them are sorted apart."""
    ranges = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    schema = StructType([*rows.schema.fields, StructField("part", IntegerType()), StructField("before", LongType())])
    sums = cut(ranges.mapInArrow(_running, schema))
    # One row a partition.
    totals = sums.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("part", F.coalesce(earlier, F.lit(0)).alias("offset"))
    return sums.join(F.broadcast(totals), "part").withColumn("before", F.col("before") + F.col("offset")).drop("part", "offset")


def _ranked(runs: DataFrame, key: list[str]) -> DataFrame:
    """runs whose key stands at two places or more, with the rank of the key and the first place in its interval."""
    repeated = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1")
    ranks = _in_order(repeated, key).withColumnRenamed("before", "rank")
    # A key with many places meets one row of ranks; its rows may be split in the join.
    return cut(runs.join(ranks, key).drop(*key, "n"))


def _suffix_ranks(lines: DataFrame) -> list[DataFrame]:
    """For runs of 1, 2, 4, ... lines: start (the document), place, fwd, rank and first of all that stand twice or more."""
    levels, size = [_ranked(lines, ["line", "line_b"])], 1
    while not levels[-1].isEmpty():
        onward = Window.partitionBy("start").orderBy("place").rangeBetween(size, size)
        pairs = levels[-1].select("start", "place", "fwd", F.col("rank").alias("lead"), F.max("rank").over(onward).alias("second"))
        levels.append(_ranked(pairs.where("second is not null"), ["lead", "second"]))
        size *= 2
    return levels


def _between_powers(levels: list[DataFrame], min_words: int) -> DataFrame:
    """start, place and end of later copies among the shortest runs whose length is no power of two."""
    both = F.array(F.struct(F.col("place").alias("head"), F.col("fwd").alias("len")), F.struct((F.col("place") + 1 - F.col("back")).alias("head"), F.col("back").alias("len")))
    runs = levels[0].select("start", F.explode(both).alias("r")).select("start", "r.*").where(F.col("len").between(3, min_words)).where(F.col("len").bitwiseAND(F.col("len") - 1) != 0)
    depth = sum((F.col("len") >= 1 << j).cast("int") for j in range(1, min_words.bit_length()))
    runs = runs.distinct().withColumn("depth", depth)
    runs = runs.withColumn("tail", F.col("head") + F.col("len") - F.expr("shiftleft(1, depth)"))
    ranks = None
    for j, level in enumerate(levels[1 : min_words.bit_length()], 1):
        here = level.select(F.lit(j).alias("depth"), "place", "rank")
        ranks = here if ranks is None else ranks.union(here)
    for end, name in (("head", "a"), ("tail", "b")):
        runs = runs.join(ranks.select("depth", F.col("place").alias(end), F.col("rank").alias(name)), ["depth", end])
    runs = cut(runs)
    first = runs.groupBy("len", "a", "b").agg(F.min("head").alias("first"))
    later = runs.join(first, ["len", "a", "b"]).where("first < head")
    return later.select("start", F.col("head").alias("place"), (F.col("head") + F.col("len")).alias("end"))


def later_copies(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash and line_no (from 0, of the text split at newlines) of every line to delete."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    lines = texts.where("text is not null").mapInArrow(_lines(min_words), _LINES)
    lines = cut(lines.withColumn("has_id", F.col("doc_id").isNotNull()).fillna(0, ["doc_id"]))
    starts = _in_order(lines.groupBy(*_DOCUMENT).agg((F.max("pos") + 1).cast("long").alias("n")), _DOCUMENT)
    starts = starts.select(*_DOCUMENT, F.col("before").alias("start"))
    placed = lines.repartition(*_DOCUMENT).dropDuplicates([*_DOCUMENT, "pos"]).join(starts, _DOCUMENT)
    levels = _suffix_ranks(placed.select("start", (F.col("start") + F.col("pos")).alias("place"), "line_no", "line", "line_b", "fwd", "back"))
    spans = levels[0].select("start", "place", "line_no", F.col("place").alias("end"))
    for j, level in enumerate(levels[:-1]):
        later = level.where(F.col("first") < F.col("place")).where(F.col("fwd").between(1, 1 << j))
        spans = spans.unionByName(later.select("start", "place", (F.col("place") + (1 << j)).alias("end")), allowMissingColumns=True)
    if min_words >= 3 and len(levels) > 2:
        spans = spans.unionByName(_between_powers(levels, min_words), allowMissingColumns=True)
    so_far = Window.partitionBy("start").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    gone = spans.withColumn("reach", F.max("end").over(so_far)).where("line_no is not null and reach > place")
    gone = gone.select("start", "line_no").join(starts, "start")
    return gone.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "text_hash", "line_no")


def delete_runs(docs: DataFrame, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with later copies deleted from the text, and the new columns n_lines (with a word, before) and n_deleted (with
    underscores behind the name, where docs has a column of that name)."""
    gone = later_copies(docs, min_words, id_col, text_col).groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash"), "gone")
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    of = dict(zip(docs.columns, names, strict=True))
    rows, text, numbers = docs.toDF(*names), F.col(of[text_col]).cast("string"), F.col("gone")
    same = F.col(of[id_col]).cast("long").eqNullSafe(F.col("g_id")) & (F.xxhash64(text) == F.col("g_hash"))
    parts = F.split(text, "\n", -1)
    left = F.filter(parts, lambda x, i: ~F.array_contains(numbers, i))
    kept = F.when(numbers.isNull(), text).otherwise(F.array_join(left, "\n"))
    lines = F.size(F.filter(parts, lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    out = rows.join(gone, same, "left").select(
        *(kept.alias(n) if n == of[text_col] else F.col(n) for n in names),
        F.when(text.isNull(), 0).otherwise(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias("n_deleted"),
    )
    return out.toDF(*docs.columns, free("n_lines", docs.columns), free("n_deleted", docs.columns))
