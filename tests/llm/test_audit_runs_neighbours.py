"""Operators 11 to 13 against plain Python; nulls, ties, repeated rows, long texts, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merchantry.llm import catalog, filter_audit, posting_lists, word_runs
from tests.llm import brute

# 11 ------------------------------------------------------------------------------------------------------------------


def fails(text, smaller):
    text = text or ""
    words = brute.words(text)
    out = {"A"} if len(words) < 50 else set()
    out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
    out |= {"D"} if re.search(r"[#$%&*|]", text) else set()
    return out | ({"E"} if smaller else set())


def audited(rows, labels):
    """(part, order, step) -> the seven counts, every document put through every order."""
    good, toxic = ({d for d, *marks in labels if marks[k] == 1} for k in (0, 1))
    docs = []
    for d, t, s in rows:
        smaller = d is not None and any((u or "") == (t or "") and x is not None and x < d for x, u, _ in rows)
        docs.append((s or "", fails(t, smaller), d in good, d in toxic))
    out, removed_by = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, *_ in docs}:
            left = [x for x in docs if x[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                now = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                only = sum(x[1] == {letter} for x in docs if x[0] == part)
                out[part, order, step] = [len(left), len(now), sum(letter in x[1] for x in gone), only, sum(x[2] for x in now), sum(x[3] for x in now)]
                removed_by[part, letter] += len(now)
                gone += now
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def counts_of(found):
    rows = found.collect()
    out = {(r.part, r.filter_order, r.step): tuple(r[c] for c in NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


def test_filter_audit(spark, docs, rows):
    rng = random.Random(8)
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, *_ in rows if rng.random() < 0.7]
    labels += [(rows[3][0], 1, 1), (None, 1, 1), (10**9, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1)).withColumn("mask", F.lit("m"))
    found = filter_audit.audit(docs, table)
    assert counts_of(found) == audited([(d, t, s) for d, t, _, s, _ in rows], labels)
    assert found.groupBy("part").count().where("count <> 600").isEmpty()


def test_filter_audit_of_copies_nulls_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 2)
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(i, long, f"s{i % 5}") for i in range(40)] + [(3, long, "s3"), (None, long, ""), (None, long, None), (-7, None, None), (5, "", "s1"), (9, "é" * 90 + "ABCDE", "s1"), (8, "X# " * 70, "s2")]
    labels = [(d, 1, 0) for d in range(0, 40, 3)] + [(-7, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    assert counts_of(filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == audited(rows, labels)


def test_filter_audit_of_nothing(spark, nothing):
    assert filter_audit.audit(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all()
    for mask in range(1, 32):
        for o, order in enumerate(filter_audit.ORDERS):
            assert mask >> "ABCDE".index(order[table[mask, o]]) & 1
            assert not any(mask >> "ABCDE".index(x) & 1 for x in order[: table[mask, o]])


# 12 ------------------------------------------------------------------------------------------------------------------


def all_runs(t, least=6, times=4):
    """Every stretch that keeps a period, period by period; the first period that gives a stretch is its smallest."""
    out = {}
    for q in range(1, len(t) // times + 1):
        i = 0
        while i + q < len(t):
            j = i
            while j + q < len(t) and t[j] == t[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted([(s, e, q) for (s, e), q in out.items()], key=lambda r: (r[0], r[2]))


def numbered(words):
    ids = {}
    return [ids.setdefault(w, len(ids)) for w in words]


@st.composite
def repetitive(draw):
    out = draw(st.lists(st.integers(0, draw(st.integers(0, 3))), max_size=30))
    for _ in range(draw(st.integers(0, 4))):
        at, size = draw(st.integers(0, len(out))), draw(st.integers(1, 9))
        out[at:at] = out[at : at + size] * draw(st.integers(1, 7))
    return numbered(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(repetitive(), max_size=4), st.sampled_from([(6, 4), (2, 2), (3, 3), (2, 5)]))
def test_runs_of_words(texts, bounds):
    assert word_runs.runs_of(texts, *bounds) == [all_runs(t, *bounds) for t in texts]


def expected_row(doc_id, text, planted):
    words = brute.words(text)
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if planted and h % 10 == 0 and n:
        a = (h // 10) % n
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    top = max(runs, key=lambda r: (r[1] - r[0], -r[0], -r[2]), default=None)
    best = (None,) * 4 if top is None else (top[0], top[1] - top[0], top[2], 1000 * (top[1] - top[0]) // top[2])
    left = [w for i, w in enumerate(words) if not any(s + q <= i < e for s, e, q in runs)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)), sha(" ".join(left)))


@pytest.mark.parametrize("planted", [False, True])
def test_word_runs(spark, docs, rows, planted, monkeypatch):
    monkeypatch.setattr(word_runs, "PIECE_WORDS", 300)
    extra = [(1000 + i, t) for i, t in enumerate(["a b " * 12, "x y x y\nx y x\ty", "go " * 500, None, "", "é è " * 9 + "\x1c\x85", "a b c " * 4 + "d " + "a b c " * 4, "A a " * 20])]
    extra += [(None, "a " * 9), (1000, "a b " * 12), (-40, "p q r s t " * 30)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("n_runs", F.lit("x"))
    got = word_runs.find(table, alter=word_runs.planted if planted else None).collect()
    assert Counter(map(tuple, got)) == Counter(expected_row(d, t, planted) for d, t in [(r[0], r[1]) for r in rows] + extra)


def test_word_runs_of_very_long_texts(spark):
    rng = random.Random(2)
    once = [f"w{rng.randrange(10**6)}" for _ in range(50_000)]
    rows = [(1, " ".join(once * 5)), (2, "a " * 400_000), (3, " ".join(once[:20_000] + ["x", "y", "z"] * 1000 + once[:20_000]))]
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period) for r in word_runs.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {1: (1, 0, 250_000, 50_000), 2: (1, 0, 400_000, 1), 3: (1, 20_000, 3000, 3)}


def test_word_runs_of_nothing(nothing):
    assert word_runs.find(nothing).count() == 0


# 13 ------------------------------------------------------------------------------------------------------------------

SCHEMA = "vec_id long, embedding array<float>, label int"


def true_neighbours(rows, queries, k):
    out = {}
    for q in queries:
        own = np.asarray(rows[q], np.float32).astype(float)
        far = sorted((float(np.sqrt(((np.asarray(v, np.float32).astype(float) - own) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out[q] = [(i, d) for d, i in far[:k]]
    return out


def answers(found):
    out = {}
    for r in sorted(found.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def clustered(n, seed=4, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, width))
    return {i: (centres[i % 40] + 0.2 * rng.normal(size=width)).tolist() for i in range(n)}


def test_neighbours_are_found(spark):
    rows = clustered(4000)
    table = spark.createDataFrame([(i, v, 0) for i, v in rows.items()], SCHEMA).repartition(7)
    got = answers(posting_lists.search(table, F.col("id") % 100 == 0, list_rows=32, block_rows=40))
    true = true_neighbours(rows, range(0, 4000, 100), 10)
    assert got.keys() == true.keys() and all(len(v) == 10 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in true[q]}) for q in true) >= 0.95 * 10 * len(true)
    for q, found in got.items():
        assert all(abs(d - dict(true_neighbours(rows, [q], 4000)[q])[i]) < 1e-12 for i, d in found)
        assert found == sorted(found, key=lambda r: (r[1], r[0]))


def test_neighbours_of_the_given_vectors(spark, sf):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = answers(catalog.op13_posting_lists(spark, sf))
    true = true_neighbours(rows, [i for i in rows if i % 100 == 0], 10)
    assert got.keys() == true.keys()
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in true[q]}) for q in true) >= 0.9 * sum(map(len, true.values()))


def test_neighbours_among_copies(spark):
    """Half of the rows hold one vector: distances of zero come in order of id, and no copy is a neighbour of itself."""
    rows = clustered(600)
    rows |= {i: [1.0] * 16 for i in range(600, 1300)}
    table = spark.createDataFrame([(i, v, 0) for i, v in rows.items()], SCHEMA).repartition(7)
    got = answers(posting_lists.search(table, F.col("id") % 100 == 0, list_rows=16, block_rows=8))
    assert got[600] == [(i, 0.0) for i in range(601, 611)] and got[1200] == [(i, 0.0) for i in range(600, 610)]
    assert all(len(v) == 10 for v in got.values()) and len(got) == 13


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (2, None), (200, [0.0, 0.0]), (3, [nan, 1.0]), (4, [1.0, None]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (300, [1.0, 2.0, 3.0]), (6, []), (7, [1.0, 0.0]), (7, [3.0, 0.0])]
    table = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = answers(posting_lists.search(table, F.col("id") % 100 == 0))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [7, 100], 100: [0, 7]}
    assert posting_lists.search(table.limit(0), F.col("id") % 100 == 0).count() == 0
    assert posting_lists.search(table.where("vec_id = 0"), F.col("id") % 100 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in posting_lists.search(huge, F.col("id") == 0).collect()] == [(1, 1.0), (2, inf)]


def test_lists_are_balanced_and_walks_reach_the_nearest():
    points = np.array(list(clustered(3000).values()))
    parts = posting_lists.balanced_lists(points, 37)
    assert sorted(np.concatenate(parts)) == list(range(3000)) and max(map(len, parts)) - min(map(len, parts)) <= 40
    index = posting_lists.fit(points, 60, 4, 1.05, 0.97, 10)
    met = posting_lists.walk(index, points[:500], 1.05, 8)
    true = ((points[:500, None] / index.scale - index.centroids[None]) ** 2).sum(-1)
    assert (met.argmin(1) == true.argmin(1)).mean() > 0.98
