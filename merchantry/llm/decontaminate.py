"""Benchmark decontamination by size-partitioned MinHash containment search (5).

A document holds an item when it has at least 75% of the item's distinct 5-word shingles (words [^\\x20\\x09-\\x0D]+, A-Z
lower-cased). Items are partitioned by size, in powers of two. An item's signature is its m least shingle hashes, m being
fixed for its partition: n - ceil(0.75 n) + 1 for the partition's greatest n. A document that holds an item misses
fewer of its shingles than that, so it has one of the signature: no item is lost, whatever the document's length.
Banded signatures of whole documents, the usual form, are not used: beside 20 thousand words an item's Jaccard
similarity is near 0.001 and most would be missed. So documents stream all their shingles past the signatures.
Candidates are verified on the words themselves: the exact share of the item's shingles in the whole document.

Items are broadcast in blocks of at most `block_bytes` of text, a pass over the documents each.

Defined results: null and blank documents and items never match; one to four words are one shingle, so a short item
matches a document of just these words; repeated documents or items give a row each; null ids stay null in the result;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm import vectors
from merchantry.llm.ngram_join import needed
from merchantry.session import cut, ship_package

BLOCK_BYTES = 8 << 20
_SCHEMA = "doc_id long, text_hash long, item_id long, n_item long, n_shared long"


def word_shingles(text: bytes, k: int) -> set[bytes]:
    """The distinct shingles as bytes, words joined by a space."""
    found = text.lower().split()  # bytes: ASCII case and white space only, 0x1C-0x1F excluded
    if len(found) < k:
        return {b" ".join(found)} if found else set()
    return {b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)}


class Index:
    """A block of items: signatures by size partition, in one sorted array of hashes."""

    def __init__(self, ids: list[int | None], texts: list[str], num: int, den: int, k: int) -> None:
        self.ids, self.k, self.num, self.den = ids, k, num, den
        self.sets = [word_shingles(t.encode(), k) for t in texts]
        column = pa.array(texts, pa.string())
        hashes = [s for piece in vectors.pieces(column) for s in vectors.shingle_sets(vectors.words(piece, lower=True), k)]
        parts: dict[int, int] = {}
        for s in hashes:
            if len(s):
                parts[len(s).bit_length()] = max(parts.get(len(s).bit_length(), 0), len(s) - needed(len(s), num, den) + 1)
        taken = [(s[: parts[len(s).bit_length()]], i) for i, s in enumerate(hashes) if len(s)]
        keys = np.concatenate([s for s, _ in taken]) if taken else np.zeros(0, np.int64)
        items = np.concatenate([np.full(len(s), i) for s, i in taken]) if taken else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]
        self.unique, self.begin = np.unique(self.keys, return_index=True)
        self.end = np.append(self.begin[1:], len(self.keys))

    def candidates(self, piece: vectors.Piece) -> dict[int, set[int]]:
        """Items to verify by text of the piece."""
        out: dict[int, set[int]] = {}
        if not len(self.unique):
            return out
        found = vectors.words(piece, lower=True)
        first, hashes = vectors.windows(found, self.k)
        text, signed = found.text[first], hashes.view(np.int64)
        short = np.flatnonzero((found.counts > 0) & (found.counts < self.k))
        if len(short):
            own = vectors.shingle_sets(found, self.k)
            text = np.concatenate([text, short])
            signed = np.concatenate([signed, *(own[t] for t in short)])
        at = np.minimum(np.searchsorted(self.unique, signed), len(self.unique) - 1)
        hit = np.flatnonzero(self.unique[at] == signed)
        pairs = np.unique(np.stack([text[hit], at[hit]], 1), axis=0) if len(hit) else np.zeros((0, 2), np.int64)
        for t, key in pairs:
            out.setdefault(int(t), set()).update(self.items[self.begin[key] : self.end[key]].tolist())
        return out


def _search(block: object) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*block.value)
        for batch in batches:
            rows: list[tuple] = []
            for piece in vectors.pieces(batch.column(1)):
                for t, items in index.candidates(piece).items():
                    own = word_shingles(piece.data[piece.offsets[t] : piece.offsets[t + 1]].tobytes(), index.k)
                    doc, text = (batch.column(c)[piece.first + t].as_py() for c in (0, 2))
                    for i in sorted(items):
                        shared, n = len(index.sets[i] & own), len(index.sets[i])
                        if index.den * shared >= index.num * n:
                            rows.append((doc, text, index.ids[i], n, shared))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "text_hash", "item_id", "n_item", "n_shared"])

    return run


def find(docs: DataFrame, benchmark: DataFrame, share: tuple[int, int] = (75, 100), words: int = 5, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64), item_id, n_item (the item's shingles) and n_shared for each document that holds an
    item."""
    spark = docs.sparkSession
    ship_package(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    items = cut(items.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Twice the blocks that an even deal needs, for texts hash unevenly; each block's size is checked before it is sent.
    blocks = 1 if size <= block_bytes else -(-2 * size // block_bytes)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    out = spark.createDataFrame([], _SCHEMA)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()  # at most a block
        if sum(len(r.text) for r in rows) > 8 * block_bytes:
            raise ValueError(f"a block of items is over {8 * block_bytes} characters; raise block_bytes")
        if rows:
            block = spark.sparkContext.broadcast(([r.id for r in rows], [r.text for r in rows], *share, words))
            out = out.union(texts.mapInArrow(_search(block), _SCHEMA))
    return out


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of docs that hold no item."""
    found = find(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    found = found.select(F.col("doc_id").alias("held_id"), F.col("text_hash").alias("held_hash")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    of = dict(zip(docs.columns, names, strict=True))
    same = F.col(of[id_col]).cast("long").eqNullSafe(F.col("held_id")) & (F.xxhash64(F.col(of[text_col]).cast("string")) == F.col("held_hash"))
    return docs.toDF(*names).join(found, same, "left_anti").toDF(*docs.columns)
