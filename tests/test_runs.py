"""Runs of tokens against plain Python, and what mining writes besides its rows."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from merchantry.functions import text as tx
from merchantry.operators import runs
from merchantry.plans import catalog
from merchantry.session import shared_folder
from merchantry.sources.tables import table


def brute(rows, longest):
    freq, sides = Counter(), ({}, {})
    for t in rows:
        for i in range(len(t)):
            for k in range(1, min(longest, len(t) - i) + 1):
                run = tuple(t[i : i + k])
                freq[run] += 1
                for side, at in zip(sides, (i - 1, i + k), strict=True):
                    if 0 <= at < len(t):
                        side.setdefault(run, Counter())[t[at]] += 1
    return freq, sides


@pytest.mark.parametrize("longest", [1, 2, 5])
@pytest.mark.parametrize(("piece", "least"), [(runs.PIECE, 1), (40, 1), (300, 4)])
def test_runs_in_pieces_and_parts(spark, monkeypatch, longest, piece, least):
    monkeypatch.setattr(runs, "PIECE", piece)
    monkeypatch.setattr(runs, "PART_BYTES", 500)
    rng = random.Random(piece)
    words = ["a", "b", "手", "éa", "c+", *(f"w{i}" for i in range(400))]
    texts = [[words[min(int(rng.expovariate(0.3)), len(words) - 1)] for _ in range(rng.choice([0, 1, 2, 3, 30]))] for _ in range(150)] + [["x"] * 70, None]
    texts += [[w] for w in words]
    made = spark.createDataFrame([(t,) for t in texts], "t array<string>").repartition(3)
    freq, sides = brute([t or [] for t in texts], longest)
    got = {tuple(r.word.split(" ")): r for r in runs.counted(made, F.col("t"), longest, least).collect()}
    assert got.keys() == {w for w, n in freq.items() if n >= least}
    for word, r in got.items():
        assert (r.len, r.freq, r.total) == (len(word), freq[word], freq.total())
        for side, (n, s) in zip(sides, ((r.left_n, r.left_s), (r.right_n, r.right_s)), strict=True):
            near = side.get(word, Counter())
            assert n == near.total() and math.isclose(s, sum(x * math.log(x) for x in near.values()), abs_tol=1e-9)
    plain = {tuple(r.word.split(" ")): r.freq for r in runs.counted(made, F.col("t"), longest, least, near=False).collect()}
    assert plain == {w: r.freq for w, r in got.items()}


def test_nothing_to_count(spark):
    made = spark.createDataFrame([([],), (None,)], "t array<string>")
    assert runs.counted(made, F.col("t"), 3).count() == 0
    assert runs.counted(made.limit(0), F.col("t"), 3).count() == 0


def written(spark):
    """Bytes shuffled by the session so far, and in its checkpoints."""
    shared_folder(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    stored = sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(folder) for x in names if not x.endswith(".crc"))
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite(), stored


@pytest.mark.parametrize("name", ["ngram_freq", "neighbour_entropy", "word_accept", "word_accept_all", "ngram_freq_all", "neighbour_entropy_all", "extract_phrases", "clean_title", "segment_texts"])
def test_mining_writes_little(spark, name):
    """Bytes shuffled and stored for each token of the corpus."""
    folder = "/root/testdata/sf0.01"
    n = table(spark, folder, "documents").agg(F.sum(F.size(tx.token_stream(F.col("text"))))).first()[0]
    before = written(spark)
    catalog.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
    assert sum(written(spark)) - sum(before) < (20 if name in ("ngram_freq", "extract_phrases", "clean_title") else 40) * n
