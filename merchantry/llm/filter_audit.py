"""Interaction of five filters under every order, by first-failure lookup (11).

Which of a document's filters removes it depends on the order they are applied in, and only on which of them it fails. So
a document is a number from 0 to 31, the set of filters it fails, and one table of 32 by 120 says at which step it goes
under each order. The table is computed once; each task looks up its documents' rows of it, counts part, order and step by
np.bincount (all documents, good ones, toxic ones), and hands on one array of 120 x 6 counts for each part it met. Arrays
are summed by place. Everything else follows from the sums: what fails a filter is what the orders that begin with it
remove first; what fails only that filter is what the orders that end with it remove last.

Filters A to D read one text. E asks for a smaller doc_id with an identical text, removed or not: the least id of every
text that stands twice is found by the SHA-256 of the text, and joined with the documents' numbers, never with their texts.
One row for each repeated text meets its documents there, so Spark may split the documents of a very common one.

Defined results: a null text is empty; a null source is the part ''; repeated rows count each; a document with a null id
is no smaller id and never fails E; of several labels of a document, one that is 1 counts; labels without a document, with
null ids or null values, and other columns are ignored; without documents there is no part and no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchantry.session import cut, ship_package

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Parts whose counts a task holds before it hands them on.
HELD_PARTS = 64
_UPPER, _MARKS, _INNER = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
_MASKS = "doc_id long, part string, mask int, digest binary"
_COUNTS = "part string, removed array<long>, good array<long>, toxic array<long>"


def first_failures() -> np.ndarray:
    """32 x 120: the step, from 0, at which a document that fails the filters of a mask goes under each order; 5 if none."""
    table = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    bits = np.arange(1 << STEPS)
    for o, order in enumerate(ORDERS):
        for step in range(STEPS - 1, -1, -1):
            table[(bits >> FILTERS.index(order[step])) & 1 == 1, o] = step
    return table


def text_mask(text: bytes, least_words: int = 50, least_distinct: int = 65, most_upper: int = 5) -> int:
    """Filters A to D that a text fails, as bits. Its words are bytes between 0x20 and 0x09-0x0D."""
    words = text.split()
    short, repeated = len(words) < least_words, 100 * len(set(words)) < least_distinct * len(words)
    upper = len(text) - len(text.translate(None, _UPPER))
    shout = 100 * upper > most_upper * len(text.translate(None, _INNER))
    marked = len(text.translate(None, _MARKS)) < len(text)
    return short | repeated << 1 | shout << 2 | marked << 3


def _masks(least_words: int, least_distinct: int, most_upper: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for value in batch.column(2):
                text = value.as_py() or b""
                masks.append(text_mask(text, least_words, least_distinct, most_upper))
                digests.append(hashlib.sha256(text).digest())
            columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", "digest"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of counts by order and step, nothing failed being the last step, for each part met."""
    table, slots = first_failures(), len(ORDERS) * (STEPS + 1)
    place = (np.arange(len(ORDERS)) * (STEPS + 1) + table).astype(np.int64)
    held: dict[str, np.ndarray] = {}

    def rows() -> pa.RecordBatch:
        names, sums = list(held), np.stack(list(held.values()))
        lists = [pa.array(list(sums[:, k]), pa.list_(pa.int64())) for k in range(3)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *lists], names=["part", "removed", "good", "toxic"])

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        code, names = parts.indices.to_numpy(), parts.dictionary.to_pylist()
        mask, good, toxic = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
        for p, name in enumerate(names):
            here = code == p
            sums = held.setdefault(name, np.zeros((3, slots), np.int64))
            for k, chosen in enumerate((here, here & good, here & toxic)):
                sums[k] += np.bincount(place[mask[chosen]].ravel(), minlength=slots)
            if len(held) >= HELD_PARTS:
                yield rows()
    if held:
        yield rows()


def failed(docs: DataFrame, least_words: int = 50, least_distinct: int = 65, most_upper: int = 5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, part and mask, the filters it fails as bits, for each row of docs."""
    ship_package(docs.sparkSession)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    masks = cut(rows.mapInArrow(_masks(least_words, least_distinct, most_upper), _MASKS))
    firsts = masks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return masks.join(firsts, "digest", "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.shiftleft(copy, STEPS - 1)).alias("mask"))


def _marked(labels: DataFrame, label_col: str, quality_col: str, toxic_col: str) -> DataFrame:
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    rows = labels.select(F.col(label_col).cast("long").alias("doc_id"), F.col(quality_col).alias("q"), F.col(toxic_col).alias("t"))
    return rows.where("doc_id is not null").groupBy("doc_id").agg(is_one("q").alias("good"), is_one("t").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, least_words: int = 50, least_distinct: int = 65, most_upper: int = 5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """part, filter_order and step (from 1), with the documents of the part that the step keeps and removes (kept,
    removed), that fail its filter but went earlier (redundant), that fail no other (unique_fails), the labelled good and
    toxic ones that it removes (good_lost, toxic_lost), and its filter's removals over all orders (shapley)."""
    masks = failed(docs, least_words, least_distinct, most_upper, id_col, text_col, source_col)
    rows = masks.join(_marked(labels, "doc_id", "quality", "toxic"), "doc_id", "left")
    flag: dict[str, Column] = {c: F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")}
    counts = rows.select("part", "mask", *flag.values()).mapInArrow(_count, _COUNTS)
    placed = counts.select("part", F.posexplode(F.arrays_zip("removed", "good", "toxic")).alias("place", "n"))
    sums = placed.groupBy("part", "place").agg(*(F.sum(f"n.{c}").alias(c) for c in ("removed", "good", "toxic")))
    orders = F.array(*(F.lit(o) for o in ORDERS))
    order = F.get(orders, F.floor(F.col("place") / (STEPS + 1)).cast("int"))
    steps = sums.select("part", order.alias("filter_order"), (F.col("place") % (STEPS + 1) + 1).cast("int").alias("step"), "removed", "good", "toxic")
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    onward = Window.partitionBy("part", "filter_order").orderBy("step").rowsBetween(1, Window.unboundedFollowing)
    of_filter = Window.partitionBy("part", "letter")
    fails = F.max(F.when(F.col("step") == 1, F.col("removed"))).over(of_filter)
    only = F.max(F.when(F.col("step") == STEPS, F.col("removed"))).over(of_filter)
    out = steps.withColumn("kept", F.sum("removed").over(onward)).where(F.col("step") <= STEPS)
    return out.select(
        "part", "filter_order", "step", "kept", "removed", (fails - F.col("removed")).alias("redundant"), only.alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("removed").over(of_filter).alias("shapley"),
    )
