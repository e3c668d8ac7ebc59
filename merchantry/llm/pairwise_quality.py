"""Quality scores by Bradley-Terry pairwise ranking (8).

Of a pair of labelled documents the good one is preferred. A document's strength is linear in features of its text, and
the chance that one is preferred is the logistic function of the difference of strengths; weights minimise the logistic
loss on feature differences, over every pair of a good and a bad labelled document outside the held-out fold, with a ridge.

Pairs grow with the square of the documents, so they are not listed. The loss of a pair and its derivatives are smooth in
the two strengths: each document is dealt to the four nodes around its strength (cubic interpolation on a grid), counts and
features are summed by node, and the sums over pairs of documents become sums over pairs of nodes. The chance of a pair is
met to within 1e-6. Each Newton step reads the features of all labelled documents twice; the driver sees sums by node.

The cut is a quantile of the strengths of all labelled documents, the share of bad ones, found exactly by counts of digits;
strengths map to scores so that the cut has score 0.7. Sums are of whole units, so they do not depend on the order of rows.

Defined results: null and empty texts are scored by the features of an empty text; repeated rows are scored each; null
ids are not held out; without good or without bad labels every score is 0.5; of several labels of a document each counts;
labels of documents that are not there are left out; an empty table has no scores; other columns are ignored, also for the score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm import vectors
from merchantry.llm.learning import fold, sigmoid
from merchantry.llm.quality_rules import _per_text, piece_features
from merchantry.session import cut, ship_package

CUT = 0.7
STEP = 1 / 16  # distance of the nodes
UNIT = 2.0**32  # units in which sums are counted
ROWS_A_TASK = 10000
_PIPE = np.zeros(256, bool)
_PIPE[ord("|")] = True


class Model(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float


def feature_matrix(piece: vectors.Piece) -> np.ndarray:
    """A row of features for each text of a piece."""
    c = piece_features(piece)
    words, lines, letters = (np.maximum(c[k], 1) for k in ("n_words", "n_lines", "n_letters"))
    found = vectors.words(piece, lower=True)
    order = np.lexsort((found.hashes, found.text))
    new = np.ones(len(order), bool)
    new[1:] = (found.hashes[order][1:] != found.hashes[order][:-1]) | (found.text[order][1:] != found.text[order][:-1])
    distinct = np.bincount(found.text[order][new], minlength=piece.n)
    symbol, shout, pipe = c["n_symbols"] / words, c["n_shout"] / words, _per_text(_PIPE[piece.data], piece.offsets) / words
    upper, again = c["n_upper"] / letters, c["n_repeat_words"] / words
    return np.stack(
        [
            np.log1p(c["n_words"]),
            np.log1p(20 * symbol),
            symbol > 0.2,
            np.log1p(20 * shout),
            shout > 0.2,
            np.log1p(20 * pipe),
            upper,
            upper > 0.4,
            c["n_dup_lines"] / lines,
            np.log1p(20 * again),
            again > 0.2,
            np.log(np.maximum(distinct, 1) / words),
            np.clip(c["word_chars"] / words, 0, 30),
            np.log1p(words / lines),
        ],
        1,
    ).astype(float)


def _listed(matrix: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)), pa.array(matrix.ravel()))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The first column of each batch and the matrix of its features."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in vectors.pieces(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), _listed(feature_matrix(piece))], names=["doc_id", "x"])


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the features of the whole text, for each row of docs."""
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_feature_batches, "doc_id long, x array<double>")


def learnt_from(counted: DataFrame, labels: DataFrame, folds: int, held_out: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """label and x of every document with label 0 or 1 that is not of the held-out fold. Rows of features are joined, no texts."""
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    return counted.join(ids, "doc_id").select("label", "x")


def _units(values: np.ndarray) -> np.ndarray:
    return np.rint(values * UNIT).astype(np.int64)


#: label, node and sums of each group of a batch's rows
Groups = tuple[np.ndarray, np.ndarray, np.ndarray]


def _totals(learnt: DataFrame, groups: Callable[[np.ndarray, np.ndarray], Groups]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By label: nodes in order, and the sums of each over all rows. groups has labels and features and gives whole units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for label, x in _matrices(batches):
            labels, nodes, sums = groups(label.to_numpy(), x)
            width = sums.shape[1]
            columns = [np.repeat(labels, width).astype(np.int32), np.repeat(nodes, width).astype(np.int64), np.tile(np.arange(width, dtype=np.int32), len(sums)), sums.ravel().astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["label", "node", "place", "units"])

    parts = learnt.mapInArrow(run, "label int, node long, place int, units long")
    found = parts.groupBy("label", "node", "place").agg(F.sum(F.col("units").cast("decimal(20,0)")).alias("units")).collect()
    out = {}
    for value in {r.label for r in found}:
        nodes = sorted({r.node for r in found if r.label == value})
        row = {n: i for i, n in enumerate(nodes)}
        sums = np.zeros((len(nodes), 1 + max(r.place for r in found)))
        for r in found:
            if r.label == value:
                sums[row[r.node], r.place] = int(r.units) / UNIT
        out[value] = np.array(nodes), sums
    return out


def _by_label(values: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], Groups]:
    """Sums of values, a row for each row of features, by label alone."""

    def groups(label: np.ndarray, x: np.ndarray) -> Groups:
        units = _units(values(x))
        return np.arange(2), np.zeros(2), np.stack([units[label == v].sum(0) for v in (0, 1)])

    return groups


def _standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / scale, -8, 8)


def _strengths(z: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """z @ weights, added in one order whatever the number of rows."""
    out = np.zeros(len(z))
    for j, w in enumerate(weights):
        out += z[:, j] * w
    return out


def _dealt(strength: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of the four nodes around each strength, and the parts (4 rows) by which cubic interpolation deals it to them."""
    place = np.floor(strength / STEP)
    t = strength / STEP - place
    parts = np.stack([-t * (t - 1) * (t - 2) / 6, (t + 1) * (t - 1) * (t - 2) / 2, -(t + 1) * t * (t - 2) / 2, (t + 1) * t * (t - 1) / 6])
    return place.astype(np.int64) - 1, parts


def _by_node(centre: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> Callable[[np.ndarray, np.ndarray], Groups]:
    """Documents and their features by label and node."""

    def groups(label: np.ndarray, x: np.ndarray) -> Groups:
        z = _standard(x, centre, scale)
        first, parts = _dealt(_strengths(z, weights))
        low = first.min()
        size = int(first.max() - low) + 4
        sums, used = np.zeros((2 * size, 1 + z.shape[1])), np.zeros(2 * size, bool)
        for k in range(4):
            place = label * size + (first - low) + k
            used[place] = True
            sums[:, 0] += np.bincount(place, _units(parts[k]), 2 * size)  # whole numbers far below 2^53: exact
            for j in range(z.shape[1]):
                sums[:, 1 + j] += np.bincount(place, _units(parts[k] * z[:, j]), 2 * size)
        places = np.flatnonzero(used)
        return places // size, places % size + low, sums[places]

    return groups


def _curves(centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, nodes: dict[int, np.ndarray], slopes: dict[int, np.ndarray]) -> Callable[[np.ndarray, np.ndarray], Groups]:
    """Products of features by label, each document weighted by the slope, given at the nodes, at its strength."""

    def groups(label: np.ndarray, x: np.ndarray) -> Groups:
        z = _standard(x, centre, scale)
        first, parts = _dealt(_strengths(z, weights))
        a, b = np.triu_indices(z.shape[1])
        sums = []
        for v in (0, 1):
            of = label == v
            at = np.searchsorted(nodes[v], first[of])  # the four nodes of a document follow each other
            slope = sum((parts[k][of] * slopes[v][at + k] for k in range(4)), np.zeros(of.sum()))
            sums.append(_units(z[of][:, a] * z[of][:, b] * slope[:, None]).sum(0))
        return np.arange(2), np.zeros(2), np.stack(sums)

    return groups


class Pairs(NamedTuple):
    """Means over all pairs of a good and a bad document, from sums by node."""

    loss: float
    gradient: np.ndarray
    cross: np.ndarray
    slopes: dict[int, np.ndarray]


def pair_means(sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> Pairs:
    """Loss and gradient, the mean product of a good document's features with a bad one's weighted by the pair's slope, and by
    label and node the mean slope against the other label's documents."""
    (bad_at, bad), (good_at, good) = (sums[v] for v in (0, 1))
    bad, good = bad / bad[:, 0].sum(), good / good[:, 0].sum()
    width, loss = bad.shape[1] - 1, 0.0
    gradient, cross = np.zeros(width), np.zeros((width, width))
    slopes = {0: np.zeros(len(bad)), 1: np.zeros(len(good))}
    for i in range(0, len(good), 512):
        rows = good[i : i + 512]
        behind = (bad_at[None, :] - good_at[i : i + 512, None]) * STEP
        chance = sigmoid(behind)  # that the bad one is preferred
        slope = chance * sigmoid(-behind)
        loss += rows[:, 0] @ np.logaddexp(0, behind) @ bad[:, 0]
        gradient += rows[:, 0] @ chance @ bad[:, 1:] - (chance @ bad[:, 0]) @ rows[:, 1:]
        cross += rows[:, 1:].T @ slope @ bad[:, 1:]
        slopes[1][i : i + 512] = slope @ bad[:, 0]
        slopes[0] += rows[:, 0] @ slope
    return Pairs(float(loss), gradient, cross, slopes)


def at_rank(keys: DataFrame, rank: int) -> int:
    """The key of a rank, from 1, found by counts of its digits of 16 bits from the highest on."""
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("key", shift)
        for r in sorted(keys.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if rank <= r.n:
                break
            rank -= r.n
        keys = keys.where(digit == r.digit)
    return r.digit


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Bits of doubles as numbers of the same order, and back."""
    return bits ^ ((bits >> 63) & 0x7FFFFFFFFFFFFFFF)


def cut_between(learnt: DataFrame, strengths: Callable[[np.ndarray], np.ndarray], rank: int) -> float:
    """The middle between the strength of a rank, from 1, and the next one in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _matrices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(_ordered((strengths(x) + 0.0).view(np.int64)))], names=["key"])

    keys = cut(learnt.mapInArrow(run, "key long"))
    low = at_rank(keys, rank)
    up_to, above = keys.agg(F.count_if(F.col("key") <= low), F.min(F.when(F.col("key") > low, F.col("key")))).first()
    return float(_ordered(np.array([low, low if up_to > rank else above])).view(np.float64).mean())


def fit(learnt: DataFrame, ridge: float = 1e-3, steps: int = 50) -> Model | None:
    """The model of all rows of learnt_from(), which are read many times; None where a label is missing."""
    found = _totals(learnt, _by_label(lambda x: np.concatenate([np.ones((len(x), 1)), x], 1)))
    if not found or any(found[v][1][0, 0] == 0 for v in (0, 1)):
        return None
    n_bad, n = found[0][1][0, 0], found[0][1][0, 0] + found[1][1][0, 0]
    # all rows are read some twenty times and take little time each: more tasks would mostly cost their starts
    learnt = learnt.coalesce(1 + int(n) // ROWS_A_TASK)
    centre = (found[0][1] + found[1][1])[0, 1:] / n
    spread = _totals(learnt, _by_label(lambda x: (x - centre) ** 2))
    scale = np.maximum(np.sqrt((spread[0][1] + spread[1][1])[0] / n), 1e-6)
    weights = np.zeros(len(centre))
    sums = _totals(learnt, _by_node(centre, scale, weights))
    means = pair_means(sums)
    for _ in range(steps):
        curves = _totals(learnt, _curves(centre, scale, weights, {v: sums[v][0] for v in sums}, means.slopes))
        upper = curves[0][1][0] / n_bad + curves[1][1][0] / (n - n_bad)
        hessian = ridge * np.eye(len(weights)) - means.cross - means.cross.T
        a, b = np.triu_indices(len(weights))
        hessian[a, b] += upper
        hessian[b[a != b], a[a != b]] += upper[a != b]
        step = np.linalg.solve(hessian, means.gradient + ridge * weights)
        step *= min(1.0, 8 / max(np.abs(step).max(), 1e-300))
        before = means.loss + ridge / 2 * weights @ weights
        while True:  # a step that is too long is halved
            sums = _totals(learnt, _by_node(centre, scale, weights - step))
            means = pair_means(sums)
            if np.abs(step).max() < 1e-5 or means.loss + ridge / 2 * (weights - step) @ (weights - step) <= before + 1e-6:
                break
            step /= 2
        weights = weights - step
        if np.abs(step).max() < 1e-5:
            break
    # interpolation is exact for cubics, so sums by node give mean and variance of the good documents' strengths
    at, good = sums[1][0] * STEP, sums[1][1][:, 0] / (n - n_bad)
    deviation = np.sqrt(max(good @ (at - good @ at) ** 2, 0.0))
    cut_at = cut_between(learnt, lambda x: _strengths(_standard(x, centre, scale), weights), round(n_bad))
    return Model(centre, scale, weights, cut_at, float(1 / max(deviation, 1e-6)))


def _scored(model: Model | None) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches):
            if model is None:
                score = np.full(len(x), 0.5)
            else:
                strength = _strengths(_standard(x, model.centre, model.scale), model.weights)
                score = sigmoid((strength - model.cut) * model.slope + np.log(CUT / (1 - CUT)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs. Labels of the held-out fold are not learnt from."""
    counted = cut(features(docs, id_col, text_col))
    model = fit(cut(learnt_from(counted, labels, folds, held_out, id_col, label_col)))
    scored = counted.mapInArrow(_scored(model), "doc_id long, score double")
    out = fold(F.col("doc_id"), folds) == held_out
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
