"""Small shared pieces: bounded labelled samples and logistic fits of the two trained scorers, free column names."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % folds, F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_out: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and label of up to `most` labelled documents of each label 0 and 1, none of the held-out fold.

    The sample is the same in every run: rows in order of a hash of the id. Null labels and ids are left out. The list of
    ids, at most 2 * most of 12 bytes, is broadcast, so that no other text is moved.
    """
    ids = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out))
    ordered = [ids.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for v in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(ordered[0].union(ordered[1])), "doc_id")


def free(name: str, columns: list[str]) -> str:
    """name, or with as many underscores behind it as it takes to be none of the columns (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights of the ridge-penalised logistic loss by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) / len(y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
