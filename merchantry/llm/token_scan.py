"""Token counts by a separator scan over flat token files (3).

write_tokens() makes flat files of 16-bit little-endian token ids, nothing else: no index, no lengths. Id 0 ends a
document, so a vocabulary id is stored plus one. A document may begin with a header of ids that carry its doc_id.

count() cuts such files into blocks wherever they end, deals the blocks to tasks, and each task reads its blocks' byte ranges
and searches them for the separator with numpy; a file of any size is read by many tasks. A block yields what it holds whole
(documents between two of its separators) and two ends: the tokens before its first separator and after its last. A prefix
scan over the ends of a file's blocks, some hundred bytes for each 4 MB, adds up what stays open from block to block, which
gives each document that crosses a boundary its length, its header and its ordinal; the documents themselves join that by block.

Tasks open byte ranges with pyarrow's file systems (file, hdfs, viewfs, s3, gs, abfs), as Spark's readers give whole files.

Defined results: a null or empty text is a document of 0 tokens; repeated rows are counted each; a null id is kept; tokens
after the last separator are a document too; an empty file or table has no documents; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchantry.session import cut, ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the published splitting pattern of the 50k byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
MAX_VOCABULARY_BYTES = 64 << 20
BLOCK_TOKENS = 1 << 21
TASK_BYTES, MAX_TASKS = 4 << 20, 1 << 16  # a scan has a task for so many bytes, and at most so many tasks
DIGIT, HEADER = 60000, 6  # a header is two 32-bit halves in three digits each, stored plus one; all 60001 for null
_ENCODINGS: dict[int, object] = {}


def _encoding(key: int, vocabulary: bytes) -> object:
    """The tokenizer of this Python worker."""
    if key not in _ENCODINGS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        if max(ranks.values()) + 1 > 0xFFFF:
            raise ValueError("the vocabulary needs more than 16 bits")
        _ENCODINGS[key] = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def header(doc_id: int | None) -> list[int]:
    if doc_id is None:
        return [DIGIT + 1] * HEADER
    halves = ((doc_id >> 32) & 0xFFFFFFFF, doc_id & 0xFFFFFFFF)
    return [h // DIGIT**p % DIGIT + 1 for h in halves for p in (2, 1, 0)]


def _encoded(vocabulary: object, key: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(key, vocabulary.value).encode_ordinary
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (batch.column(c).slice(at, 256).to_pylist() for c in (0, 1))
                rows = [(np.array(header(i) + [t + 1 for t in encode(x or "")], "<u2")).tobytes() for i, x in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["data"])

    return run


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the flat files of docs below folder; returns folder. The vocabulary's size is checked before it is sent."""
    ship_package(docs.sparkSession)
    if os.path.getsize(vocabulary) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to send to every executor")
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    data = rows.mapInArrow(_encoded(sent, hash(vocabulary)), "data binary")
    # The text writer writes a value's bytes as they are and the separator after each: a flat file on any file system.
    data.select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\0\0").text(folder)
    return folder


def _opened(path: str) -> pa.NativeFile:
    """The file at a path as Spark writes it, which is not percent-encoded."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        local = rest if scheme == "file" and colon else path
        return fs.LocalFileSystem().open_input_file("/" + local.lstrip("/"))
    system, inner = fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{quote(rest, safe='/:@')}")
    return system.open_input_file(inner)


def _scan(n_header: int, step: int) -> object:
    names = ["path", "block", "n_tokens", "n_sep", "head", "tail", "head_ids", "tail_ids", "docs", "counts"]
    types = [pa.string(), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(path) as f:
                    ids = np.frombuffer(f.read_at(step, block * step), "<u2")
                seps = np.flatnonzero(ids == 0)
                head = int(seps[0]) if len(seps) else len(ids)
                tail = len(ids) - int(seps[-1]) - 1 if len(seps) else len(ids)
                counts, found = np.diff(seps) - 1, []
                if n_header and len(counts):
                    digits = ids[seps[:-1, None] + 1 + np.arange(n_header)].astype(np.int64)
                    place = np.array([DIGIT**2, DIGIT, 1], np.int64)
                    high, low = ((digits[:, k : k + 3] - 1) @ place for k in (0, 3))
                    known = digits[:, 0] <= DIGIT
                    value = (high.astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)).view(np.int64)
                    found = [int(v) if ok else None for v, ok in zip(value, known, strict=True)]
                first = ids[: min(head, n_header)].tolist()
                last = ids[len(ids) - tail :][:n_header].tolist()
                row = (path, block, len(ids), len(seps), head, tail, first, last, found or [None] * len(counts), counts.tolist())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return run


def _decoded(ids: Column) -> Column:
    half = lambda k: sum((F.get(ids, F.lit(k + j)) - 1) * DIGIT ** (2 - j) for j in range(3))
    whole = F.shiftleft(half(0), 32).bitwiseOR(half(3))
    return F.when(F.get(ids, F.lit(0)) <= DIGIT, whole)


def count(spark: SparkSession, folder: str, n_header: int = HEADER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """path, ordinal (from 0, within the file), doc_id (null without a header) and n_tokens (without header and
    separator) for each document of the flat files below folder."""
    if n_header not in (0, HEADER) or block_tokens < HEADER:
        raise ValueError("a header has 0 or 6 ids and fits in a block")
    ship_package(spark)
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("path", "length")
    step = 2 * block_tokens
    whole = F.when(F.col("length") % 2 == 0, F.col("length")).otherwise(F.raise_error(F.lit("a file does not hold whole tokens")).cast("long"))
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((whole - 1) / step))).alias("block"))
    tasks = files.agg(F.ceil(F.sum("length") / TASK_BYTES)).first()[0]
    found = cut(
        blocks.repartition(max(1, min(tasks or 0, MAX_TASKS))).mapInArrow(
            _scan(n_header, step),
            "path string, block long, n_tokens long, n_sep long, head long, tail long, head_ids array<long>, tail_ids array<long>, docs array<long>, counts array<long>",
        )
    )
    whole_docs = found.select("path", "block", "docs", "counts")
    found = found.drop("docs", "counts")
    order = Window.partitionBy("path").orderBy("block")
    found = found.withColumn("segment", F.count_if(F.col("n_sep") > 0).over(order))
    in_segment = Window.partitionBy("path", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    none = F.array().cast("array<long>")
    second = F.coalesce(F.nth_value("tail_ids", 2).over(in_segment), none)
    scanned = found.select(
        "*",
        F.sum("tail").over(in_segment).alias("open"),
        F.slice(F.concat(F.first("tail_ids").over(in_segment), second), 1, max(n_header, 1)).alias("open_ids"),
        F.coalesce(F.sum("n_sep").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (F.lead("block").over(order).isNull()).alias("last"),
    )
    carried = scanned.select(
        *(c for c in scanned.columns if c != "tail_ids"),
        F.coalesce(F.lag("open").over(order), F.lit(0)).alias("carry"),
        F.coalesce(F.lag("open_ids").over(order), none).alias("carry_ids"),
    ).join(whole_docs, ["path", "block"])
    doc = lambda ordinal, ids, n: F.struct(ordinal.cast("long").alias("ordinal"), ids.alias("doc_id"), (n - n_header).cast("long").alias("n_tokens"))
    own = lambda ids: _decoded(ids) if n_header else F.lit(None).cast("long")
    stitched = doc(F.col("before"), own(F.concat("carry_ids", "head_ids")), F.col("carry") + F.col("head"))
    inner = F.transform(F.arrays_zip("docs", "counts"), lambda d, i: doc(F.col("before") + 1 + i, d["docs"], d["counts"]))
    ended = F.when(F.col("n_sep") > 0, F.concat(F.array(stitched), inner)).otherwise(F.array().cast("array<struct<ordinal:bigint,doc_id:bigint,n_tokens:bigint>>"))
    left_open = doc(F.col("before") + F.col("n_sep"), own(F.col("open_ids")), F.col("open"))
    rest = F.when(F.col("last") & (F.col("open") > 0), F.array(left_open)).otherwise(F.array().cast("array<struct<ordinal:bigint,doc_id:bigint,n_tokens:bigint>>"))
    return carried.select("path", F.explode(F.concat(ended, rest)).alias("d")).select("path", "d.*")
