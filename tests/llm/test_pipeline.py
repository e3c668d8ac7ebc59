"""The stages one by one and the whole, against brute force; and the numbered queries against their SQL."""

import random
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from merchantry.llm import catalog
from tests.llm import brute
from tests.llm.conftest import sentence


def brute_run(rows, items):
    """Rows (doc_id, text, lang, source, n_chars) that the stages keep; the last as a count of copies."""
    out = [[r for r in rows if not brute.base_failed(r[1])]]
    gone = brute.deleted_lines([(r[0], r[1]) for r in out[-1]])
    cut = [(r[0], brute.without_lines(r[1], gone.get(r[0])), *r[2:4]) for r in out[-1]]
    out.append([(*r, len(r[1])) for r in cut if brute.words(r[1])])
    found = brute.components([(r[0], r[1]) for r in out[-1]])
    out.append([r for r in out[-1] if found[r[0]][1] == r[0]])
    held = {d for d, *_ in brute.contained([(r[0], r[1]) for r in out[-1]], items)}
    out.append([r for r in out[-1] if r[0] not in held])
    copies = {d: c for d, _, _, _, c in brute.mix([(r[0], r[1], r[3]) for r in out[-1]])}
    out.append([(*r, k) for r in out[-1] for k in range(1, copies[r[0]] + 1)])
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(rows[0][0], 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = items_of(rows)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def items_of(rows):
    long = [t for _, t, *_ in rows if len(brute.words(t)) > 60]
    return [(1, " ".join(brute.words(long[3])[3:30])), (2, " ".join(brute.words(long[-2])[100:120]))]


def test_stages(spark, rows, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), expected in zip(corpus_pipeline.STAGES, brute_run(rows, items_of(rows)), strict=True):
        out = stage(spark, docs, folder)
        if name != "mixing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert Counter(map(tuple, out.collect())) == Counter(map(tuple, expected)), name
        docs = spark.createDataFrame(expected, out.schema) if name != "mixing" else out


def test_stages_keep_columns_of_any_name(spark, docs, folder):
    """Names with dots, fields with spaces, and names that the stages use inside, pass through every stage."""
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, folder)
        assert now.columns[: len(docs.columns)] == docs.columns, name
        found = now.select("`meta.url`", "odd.`a b`", "c0", "doc_id").collect()
        assert {tuple(r)[:3] for r in found} == {("u", 11, 5)} and found, name


def test_learnt_cutoffs_act_in_the_first_stage(spark, tmp_path):
    """Enough labelled documents prove a cutoff: it rejects unlabelled junk and keeps what the labels call good."""
    rng = random.Random(4)
    good = [(i, sentence(rng, 50), "en", "s", 1) for i in range(900)]
    junk = [(1000 + i, " ".join(w + "###" for w in sentence(rng, 50).split()), "en", "s", 1) for i in range(60)]
    spark.createDataFrame([(i, 1, 0) for i in range(880)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert sorted(map(tuple, kept.collect())) == good


def test_run(spark, rows, folder):
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(brute_run(rows, items_of(rows))[-1])


def test_stages_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    found = catalog.queries()[name](spark, sf)
    assert sorted(found.columns) == sorted(columns)
    key = lambda r: repr([float(f"{v:.9g}") if isinstance(v, float) else v for v in r])
    assert Counter(map(key, map(tuple, found.select(columns).collect()))) == Counter(map(key, result.fetchall()))
