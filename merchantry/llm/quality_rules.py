"""Quality rules whose cutoffs are chosen under a bound on false rejection (6).

Each rule rejects a document where one of its ratios exceeds a cutoff. Labelled good documents tell how often a cutoff
would reject wrongly. Within a stratum (a band of lengths) and rule, cutoffs are tested from the most lenient to the
strictest, in fixed order, until the exact (Clopper-Pearson) upper bound on the share of good documents rejected exceeds
the rule's part of the risk; the last one that passed is taken. Fixed order needs no correction within a rule; across
rules and strata the error is divided by their number (Bonferroni), and the risk by the number of rules, so the bounds
hold for all at once. A stratum with too few labels has no cutoff: its documents are kept.

Defined results: a null text has no words and fails the base rules; repeated rows give a row each; null ids are kept as
rows; labels of documents that are not there and null labels are left out; of several labels of a document each counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from merchantry.llm import vectors
from merchantry.session import cut, ship_package

#: Rule: its cutoffs from lenient to strict. A ratio of a count and the number of words, bytes of words or lines.
RULES = {
    "symbol_ratio": (3.0, 2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2),
    "shout_ratio": (3.0, 2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2),
    "upper_ratio": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "dup_line_ratio": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "repeat_ratio": (0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05),
}
BANDS = (20, 100, 400)
SYMBOLS = b"#*$%&|<>"

_FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_shout long, n_letters long"


def _marked(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_IS_SYMBOL, _IS_SHOUT = _marked(SYMBOLS), _marked(b"!?")
_IS_UPPER, _IS_LETTER = _marked(bytes(range(65, 91))), _marked(bytes([*range(65, 91), *range(97, 123)]))


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _twice(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks in the given order: the value stands more than once in its text; and it is not its first there."""
    repeated, later = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    order = np.lexsort((hashes, text))
    same = (text[order][1:] == text[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    later[order[1:][same]] = True
    return repeated, later


def _repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """How many of the given ranges of each text have the bytes of an earlier one; bytes, not hashes, are compared."""
    held, seen, out = data.tobytes(), set(), np.zeros(n, np.int64)
    for a, b, t in zip(starts.tolist(), ends.tolist(), text.tolist(), strict=True):
        size = len(seen)
        seen.add((t, held[a:b]))
        out[t] += len(seen) == size
    return out


def piece_features(piece: vectors.Piece) -> dict[str, np.ndarray]:
    """The counts of each text of a piece."""
    found = vectors.words(piece)
    data, offsets = piece.data, piece.offsets
    first, hashes = vectors.windows(found, 8)
    repeated, _ = _twice(found.text[first], hashes)
    covered = np.zeros(len(found.text) + 9, np.int64)
    np.add.at(covered, first[repeated], 1)
    np.add.at(covered, first[repeated] + 8, -1)
    in_repeat = np.cumsum(covered)[: len(found.text)] > 0
    starts, ends = vectors.edges(data != 10, offsets)
    words_before = np.searchsorted(found.starts, np.stack([starts, ends]))
    starts, ends = (x[words_before[1] > words_before[0]] for x in (starts, ends))
    line_text = np.searchsorted(offsets, starts, "right") - 1
    repeated_line, _ = _twice(line_text, vectors.hashes(data, starts, ends))
    in_word = ~vectors._SPACE[data]
    return {
        "n_words": found.counts,
        "word_chars": _per_text(in_word & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_text(_IS_SYMBOL[data], offsets),
        "n_dup_lines": _repeats(data, starts[repeated_line], ends[repeated_line], line_text[repeated_line], piece.n),
        "n_repeat_words": np.bincount(found.text[in_repeat], minlength=piece.n),
        "n_lines": np.bincount(line_text, minlength=piece.n),
        "n_upper": _per_text(_IS_UPPER[data], offsets),
        "n_shout": _per_text(_IS_SHOUT[data], offsets),
        "n_letters": _per_text(_IS_LETTER[data], offsets),
    }


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in vectors.pieces(batch.column(1)):
            found = piece_features(piece)
            columns = [batch.column(0).slice(piece.first, piece.n), *(pa.array(v.astype(np.int64)) for v in found.values())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *found])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text; see piece_features()."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_feature_batches, _FEATURES)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The ratios that the rules test, by rule."""
    parts = {
        "symbol_ratio": ("n_symbols", "n_words"),
        "shout_ratio": ("n_shout", "n_words"),
        "upper_ratio": ("n_upper", "n_letters"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "repeat_ratio": ("n_repeat_words", "n_words"),
    }
    return {k: F.col(a) / F.greatest(F.col(b), F.lit(1)) for k, (a, b) in parts.items()}


def stratum() -> Column:
    """Number of the band of lengths."""
    return sum(((F.col("n_words") >= b).cast("int") for b in BANDS), F.lit(0))


def upper_bound(k: int, n: int, error: float) -> float:
    """Exact upper bound, at confidence 1 - error, on a share of which k of n trials were seen."""
    if k >= n:
        return 1.0
    log_terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        logs = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(log_terms)]
        top = max(logs)
        tail = math.exp(top) * sum(math.exp(x - top) for x in logs)
        low, high = (p, high) if tail > error else (low, p)
    return high


def choose_cutoffs(good: dict[int, int], rejected: dict[tuple[int, str, int], int], risk: float, error: float) -> dict[int, dict[str, float]]:
    """Cutoff of each stratum and rule that has one. good: labelled good documents by stratum; rejected: of those, the
    ones over the cutoff, by stratum, rule and the cutoff's place."""
    tests, out = len(RULES) * max(1, len(BANDS)), {}
    for s, n in good.items():
        for rule, cutoffs in RULES.items():
            for j, cutoff in enumerate(cutoffs):
                # the bound rises with k; a share already over the risk needs no exact sum
                k = rejected.get((s, rule, j), 0)
                if n == 0 or k / n > risk / len(RULES) or upper_bound(k, n, error / tests) > risk / len(RULES):
                    break
                out.setdefault(s, {})[rule] = cutoff
    return out


def fit_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> dict[int, dict[str, float]]:
    """Cutoffs from all labelled documents; one row of counts for each band reaches the driver."""
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id"))
    rows = counted.where(~base_failed()).join(good, "doc_id").withColumn("stratum", stratum())
    sums = [
        F.count_if(ratio > c).alias(f"{rule}:{j}") for rule, ratio in ratios().items() for j, c in enumerate(RULES[rule])
    ]
    found = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("good"), *sums).collect()  # at most len(BANDS) + 1 rows
    rejected = {(r["stratum"], rule, j): r[f"{rule}:{j}"] for r in found for rule in RULES for j in range(len(RULES[rule]))}
    return choose_cutoffs({r["stratum"]: r["good"] for r in found}, rejected, risk, error)


def verdict(cutoffs: dict[int, dict[str, float]]) -> Column:
    """True where a document passes the base rules and its stratum's cutoffs."""
    ratio, over = ratios(), F.lit(False)
    for s, rules in cutoffs.items():
        for rule, cutoff in rules.items():
            over = over | ((stratum() == s) & (ratio[rule] > cutoff))
    return ~base_failed() & ~over


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of docs."""
    counted = cut(features(docs, id_col, text_col))
    cutoffs = fit_cutoffs(counted, labels, risk, error)
    return counted.withColumns({"base_failed": base_failed(), "kept": verdict(cutoffs)})


def _appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        for piece in vectors.pieces(texts):
            found = piece_features(piece)
            own = batch.slice(piece.first, piece.n)
            columns = [*own.columns[:-1], *(pa.array(v.astype(np.int64)) for v in found.values())]
            yield pa.RecordBatch.from_arrays(columns, names=[*own.schema.names[:-1], *found])


def keep(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with all their columns and no shuffle of texts: counts are taken once for the cutoffs
    and once more beside each row."""
    cutoffs = fit_cutoffs(cut(features(docs, id_col, text_col)), labels, risk, error)
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    plain = docs.toDF(*names)
    counts = [StructField(c.split()[0], LongType()) for c in _FEATURES.split(", ")[1:]]
    schema = StructType([*plain.schema.fields, *counts])
    counted = plain.withColumn("text", F.col(names[docs.columns.index(text_col)]).cast("string")).mapInArrow(_appended, schema)
    return counted.where(verdict(cutoffs)).select(names).toDF(*docs.columns)
