"""Titles searched in tasks give what joins with the dictionary give."""

import random

import pytest
from pyspark.sql import functions as F

from merchantry.operators import phrases, tries, vectors


@pytest.mark.parametrize("kept", [tries.KEPT_WINDOWS, 1])
def test_sent_and_joined_dictionaries(spark, monkeypatch, kept):
    rng = random.Random(kept)
    names = [(" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 5))), rng.randint(1, 9)) for _ in range(25)] + [("A b", 4), ("a B", 4), ("a b", None), (None, 3), ("", 2)]
    titles = [(i, [rng.choice("abcdABx手") for _ in range(rng.choice([0, 1, 2, 30]))]) for i in range(120)] + [(900, None)]
    rows = spark.createDataFrame(titles, "id long, tokens array<string>")
    dictionary = spark.createDataFrame(names, "word string, freq long")
    low = rows.where("tokens is not null").select("id", F.transform("tokens", lambda t: F.lower(t)).alias("tokens"))

    def results():
        found = {r.id: r.found for r in phrases.extracted(low, "id", dictionary).collect()}
        left = {r.id: r.kept for r in phrases.removed(rows, "id", dictionary.select("word")).collect()}
        parts = {r.id: r.segments for r in phrases.segmented(rows, "id", dictionary.where("freq is not null")).collect()}
        return found, left, parts

    monkeypatch.setattr(phrases, "SHIPPED", -1)
    joined = results()
    monkeypatch.setattr(phrases, "SHIPPED", 8)
    monkeypatch.setattr(tries, "KEPT_WINDOWS", kept)
    monkeypatch.setattr(vectors, "PIECE_TOKENS", 50)
    assert results() == joined and all(joined)
