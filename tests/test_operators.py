"""Operators against plain Python on small tables."""

import datetime as dt
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from merchantry import session
from merchantry.functions import props
from merchantry.functions import text as tx
from merchantry.operators import grouping, lookups, merge, paging, score, tree, vectors, words
from merchantry.plans import mining
from merchantry.sources import files
from merchantry.sources.tables import table
from merchantry.streaming import incremental


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k long, s string, n long")
    new = spark.createDataFrame([(2, None, 7), (3, "c", None)], "k long, s string, n long")
    once = merge.upsert(old, new, "k")
    expected = {(1, "a", None), (2, "b", 7), (3, "c", None)}
    assert {tuple(r) for r in once.collect()} == expected
    assert {tuple(r) for r in merge.upsert(once, new, "k").collect()} == expected


def test_allocated_ids_are_unique_and_ordered(spark):
    rows = spark.range(0, 1000, 3).withColumn("x", F.col("id") * 2)
    got = [(r.id, r.new) for r in paging.allocate_ids(rows, ["id"], 50, "new", slices=7).orderBy("id").collect()]
    assert [n for _, n in got] == list(range(51, 51 + len(got)))
    assert paging.allocate_ids(rows.limit(0), ["id"], 0, "new").count() == 0


def test_pages_cover_all_rows(spark):
    rows = spark.range(101).withColumn("x", F.col("id") % 7)
    seen = [r.id for p in (1, 2, 3) for r in paging.page(rows, [F.desc("x"), "id"], p, 50).collect()]
    assert sorted(seen) == list(range(101))
    info = rows.agg(F.count("*").alias("t")).select(*paging.page_info(F.col("t"), 3, 50)).first()
    assert tuple(info) == (3, 2, 0)


def test_price_band_join_loses_nothing(spark):
    prices = [0.0, 1.0, 1.3, 1.42, 1.43, 2.0, 700.0, 999.9, 1000.0, 1428.5]
    items = spark.createDataFrame([(i, "c", p) for i, p in enumerate(prices)], "i long, c string, p double")
    groups = items.select(F.col("i").alias("g"), "c", F.col("p").alias("gp"))
    got = {(r.i, r.g) for r in lookups.price_band(items, groups, "c", "p", "gp", 0.3).collect()}
    diff = lambda a, b: 0 if max(a, b) == 0 else 1 - min(a, b) / max(a, b)
    assert got == {(i, j) for i, a in enumerate(prices) for j, b in enumerate(prices) if diff(a, b) <= 0.3}


def test_tree_with_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("r", None), ("x", "r")], "node string, parent string")
    assert tree.closure(edges, depth=5).where("node = 'x'").count() == 2
    assert {r.node for r in tree.descendants(edges, "r").collect()} == {"x"}


def test_tree_of_json(spark):
    node = "name string, children array<struct<name string, children array<struct<name string>>>>"
    text = '[{"name": "a", "children": [{"name": "b", "children": [{"name": "c"}]}]}]'
    parsed = spark.createDataFrame([(text,)], "s string").select(F.from_json("s", f"array<struct<{node}>>").alias("t"))
    rows = [tuple(x) for level in parsed.select(*tree.flatten(F.col("t"))).first() for x in level]
    assert rows == [(10, 0, "a"), (100, 10, "b"), (1000, 100, "c")]


def brute_words(titles, longest):
    freq, left, right = Counter(), {}, {}
    for t in titles:
        for i in range(len(t)):
            for k in range(1, min(longest, len(t) - i) + 1):
                w = " ".join(t[i : i + k])
                freq[w] += 1
                left.setdefault(w, Counter())[t[i - 1] if i else None] += 1
                right.setdefault(w, Counter())[t[i + k] if i + k < len(t) else None] += 1
    return freq, left, right


def test_entropy_with_and_without_boundaries(spark):
    titles = [["a", "b", "a"], ["b", "a", "c"], ["a"]]
    rows = spark.createDataFrame([(t,) for t in titles], "t array<string>")
    runs = words.neighbours(rows, F.col("t"), 2)
    freq, left, right = brute_words(titles, 2)
    assert {r.word: r.freq for r in words.frequencies(rows, F.col("t"), 2).collect()} == dict(freq)
    for side, near in (("left", left), ("right", right)):
        for boundary in (False, True):
            for r in words.entropy(runs, side, boundary).collect():
                seen = {k: n for k, n in near[r.word].items() if k is not None}
                ends = near[r.word][None] if boundary else 0
                total = sum(seen.values()) + ends
                want = -sum(n / total * math.log(n / total) for n in seen.values()) + (ends / total * math.log(total) if ends else 0)
                assert math.isclose(r[f"entropy_{side}"], want, abs_tol=1e-9)


def test_words_of_han_runs(spark):
    rows = spark.createDataFrame([(f"{a}手机{b}，x",) for a in "甲乙丙丁戊己庚辛" for b in "子丑寅卯辰巳午未"], "title string")
    found = {r.word: r.freq for r in words.discover_han(rows, "title", longest=3, ratio=2, freq=5, least_entropy=1.5).collect()}
    assert found["手机"] == 64 and "手" not in found and "机子" not in found


def test_dictionary_merge(spark):
    old = spark.createDataFrame([("a", 10, 0.1), ("b", 3, 0.2)], "word string, freq long, prob double")
    new = spark.createDataFrame([("a", 5, 0.3), ("c", 4, 0.4)], "word string, freq long, prob double")
    got = {r.word: (r.freq, round(r.prob, 6)) for r in words.merge_dictionary(old, new, F.lit(50)).collect()}
    assert got == {"a": (15, 0.1), "b": (3, 0.2), "c": (4, 0.4)}


def test_leader_groups(spark):
    rows = [("c", 1, 10.0, ["a", "b"]), ("c", 2, 11.0, ["a", "b"]), ("c", 3, 20.0, ["a", "b"]), ("c", 4, 10.0, ["a", "x"]), ("d", 5, 10.0, ["a", "b"]), ("c", 6, 10.0, ["a", "b"])]
    items = spark.createDataFrame([(*r, [1.0] * len(r[3])) for r in rows], "category string, item long, price double, terms array<string>, weights array<double>")
    got = {r.item: r.group_lead for r in grouping.leader_groups(items).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1}


def test_leader_groups_continue_across_batches(spark):
    names = [["a", "b"], ["a", "c"], ["b", "c", "d"]]
    rows = [("cd"[i % 2], i, 10.0 + (i * 7) % 5 * (1 + i // 20), names[i % 3]) for i in range(60)]  # copies weigh as well
    items = spark.createDataFrame([(*r, [1.0] * len(r[3])) for r in rows], "category string, item long, price double, terms array<string>, weights array<double>")
    groups, expected = [], {}
    for category, item, price, terms in rows:
        near = [g for g in groups if g[:2] == [category, terms] and 1 - min(g[2], price) / max(g[2], price) <= 0.3]
        if near:
            near[0][2:4] = [(near[0][2] * near[0][3] + price) / (near[0][3] + 1), near[0][3] + 1]
        else:
            groups.append([category, terms, price, 1, item])
        expected[item] = (near or groups[-1:])[0][4]
    assert len({(c, p, tuple(t)) for c, _, p, t in rows}) < len(rows)
    for batch in (4, 10_000):
        assert {r.item: r.group_lead for r in grouping.leader_groups(items, batch=batch).collect()} == expected


def test_leader_groups_go_on_in_a_later_run(spark):
    schema = "category string, item long, price double, terms array<string>, weights array<double>"
    rows = [("c", i, 10.0 + i % 3, ["a", "b"] if i % 2 else ["a", "c"], [1.0, 1.0]) for i in range(20)] + [("d", 99, 1.0, ["z"], [1.0])]
    items = spark.createDataFrame(rows, schema)
    whole, groups = grouping.continued(items)
    first, state = grouping.continued(items.where("item < 9 or category = 'd'"), batch=3)
    second, after = grouping.continued(items.where("item >= 9 and category = 'c'"), state, items.select("item"), batch=3)
    assert sorted(first.union(second).collect()) == sorted(whole.collect())
    assert sorted(map(str, after.collect())) == sorted(map(str, groups.collect()))
    # Without its lead a group takes no part any more.
    third, _ = grouping.continued(items.where("item >= 9 and category = 'c'"), state, items.where("item <> 1").select("item"))
    assert {r.item: r.group_lead for r in third.collect()} == {i: 9 if i % 2 else 0 for i in range(9, 20)}


def test_shop_priority_at_its_boundaries(spark):
    rows = spark.createDataFrame([(s, n, k) for s in (4, 5, 19, 20, 29, 30, 31, 99, 100) for n in (0, 2999, 3000, 4000) for k in (0, 1, 20)], "s long, l long, n long")
    for r in rows.select("*", score.shop_priority(F.col("l"), F.col("s"), F.col("n")).alias("p")).collect():
        per = r.l // r.n if r.n else 0
        assert r.p == (5 if r.s >= 100 else 6 if r.s >= 20 and per >= 200 else 7 if r.s >= 30 else 8 if r.l >= 3000 else 9 if r.s >= 5 else 10)


def test_cosines_of_all_terms(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", tx.token_stream(F.col("text")).alias("t")).collect()
    bags = {r.doc_id: Counter(r.t) for r in docs}
    norms = {k: math.sqrt(sum(n * n for n in b.values())) for k, b in bags.items()}
    expected = {}
    for q in (k for k in bags if k % 100 == 0):
        for d in bags.keys() - {q}:
            cos = sum(n * bags[d][t] for t, n in bags[q].items()) / ((norms[q] * norms[d]) or 1)
            if cos >= 0.3:
                expected[q, d] = cos
    got = {(r.query, r.doc_id): r.cosine for r in mining.cosine_sparse_all(spark, sf).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-6 for k in got)
    high = {(r.query, r.doc_id): r.cosine for r in mining.cosine_sparse(spark, sf).collect()}
    assert high == {k: c for k, c in got.items() if c >= 0.8} and high


def test_cosines_of_split_terms(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SPLIT_ROWS", 10)
    rng = random.Random(3)
    bags = {i: {rng.choice("abcdefghij") + str(rng.randrange(3)): rng.randint(1, 9) / 3 for _ in range(rng.randint(1, 12))} for i in range(120)}
    terms = spark.createDataFrame([(i, t, w) for i, b in bags.items() for t, w in b.items()] + [(500, "a0", 0.0)], "k long, term string, weight double")
    norm = lambda b: math.sqrt(sum(w * w for w in b.values()))
    for least in (0.2, 0.6, 0.95):
        got = {(r["query"], r.k): r.cosine for r in vectors.similar(terms, terms.where("k % 10 = 0"), "k", least).collect()}
        dots = {(q, d): sum(w * bags[d].get(t, 0) for t, w in bags[q].items()) / (norm(bags[q]) * norm(bags[d])) for q in range(0, 120, 10) for d in bags if d != q}
        assert got.keys() == {p for p, c in dots.items() if c >= least} and all(abs(c - dots[p]) < 1e-9 for p, c in got.items())


def test_mining_of_runs_up_to_five(spark, sf):
    docs = [r.t for r in table(spark, sf, "documents").select(tx.token_stream(F.col("text")).alias("t")).collect()]
    freq, sides = Counter(), ({}, {})
    for t in docs:
        for i in range(len(t)):
            for k in range(1, min(5, len(t) - i) + 1):
                word = " ".join(t[i : i + k])
                freq[word] += 1
                for side, at in zip(sides, (i - 1, i + k), strict=True):
                    near = side.setdefault(word, Counter())
                    if 0 <= at < len(t):
                        near[t[at]] += 1
    total = sum(freq.values())
    got = {r.word: (r.len, r.freq, r.prob) for r in mining.ngram_freq_all(spark, sf).collect()}
    assert {w: g[1] for w, g in got.items()} == freq
    assert all(g[0] == w.count(" ") + 1 and abs(g[2] - freq[w] / total) < 1e-9 for w, g in got.items())
    entropy = lambda c: -sum(n / c.total() * math.log(n / c.total()) for n in c.values())
    both = {r.word: r.entropy_right for r in mining.neighbour_entropy_all(spark, sf).collect()}
    assert both.keys() == freq.keys() and all(abs(h - entropy(sides[1][w])) < 2e-6 for w, h in both.items())
    expected = []
    for w, n in freq.items():
        t, least = w.split(" "), min(entropy(side[w]) for side in sides)
        split = min((freq[" ".join(t[:i])] * freq[" ".join(t[i:])] / total**2 for i in range(1, len(t))), default=1)
        if least >= 2.8 and ((len(t) > 1 and n >= 10 and n / total / split >= 200) or (len(t) == 1 and len(w) > 1 and n >= 300)):
            expected.append((n, round(least, 4)))
    assert sorted((r.freq, round(r.entropy, 4)) for r in mining.word_accept_all(spark, sf).collect()) == sorted(expected)


def test_standard_item(spark):
    schema = "num_iid long, api_data struct<title string, nick string, cid long, price string, props_name string, item_imgs array<struct<url string>>>"
    raw = spark.createDataFrame([(1, ("t", "n", 7, "x9", "1:2:a:b", [("u1",), ("u2",)]))], schema)
    row = props.standard_item(raw).first()
    assert (row.price, row.props, row.item_imgs, row.in_stock) == (None, {"a": "b"}, ["u1", "u2"], True)
    params = props.upload_params(props.standard_item(raw), "num_iid", ["title", "cid"], "item_imgs").collect()
    assert [(r.name, r.value) for r in params] == [("title", "t"), ("cid", "7"), ("image_url", "u1"), ("image_url", "u2")]


def test_text_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\t1\ny\t2\n\nz\t3\n")
    assert [tuple(r) for r in files.tsv(spark, str(tmp_path / "a.tsv"), ["s", "n", "more"], start=1).collect()] == [("y", "2", None), ("z", "3", None)]
    assert files.lines(spark, str(tmp_path / "a.tsv")).count() == 3
    rows = spark.createDataFrame([("a b", 1), (None, 2)], "s string, n long")
    files.write_tsv(rows, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["\t2", "a b\t1"]
    (tmp_path / "p1.json").write_text('[{"id": 1}, {"id": 2}]')
    (tmp_path / "p2.json").write_text("[]")
    assert files.captured_pages(spark, str(tmp_path / "p*.json"), "struct<id long>").count() == 2
    report = [r.value for r in files.html_report(rows, ["n"], "t").collect()]
    assert len(report) == 4 and "<td>a b</td>" in report[1]


def test_marks_skip_no_ties(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, t) for i in range(10)], "k long, t timestamp")
    marks = spark.createDataFrame([], "job string, t timestamp, k long")
    seen = []
    for _ in range(4):
        batch, marks = incremental.read_batch(rows, marks, "j", "t", "k", 4)
        seen += [r.k for r in batch.collect()]
    assert seen == list(range(10))


def test_retries(spark):
    failed = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    results = spark.createDataFrame([(1, True), (2, False)], "k long, soft boolean")
    assert {r.k for r in incremental.retried(failed, results, "k").collect()} == {1, 3}


def test_spread_deals_a_scan_of_one_row_group(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    rows = spark.read.parquet(f"{tmp_path}/one")
    cores = spark.sparkContext.defaultParallelism
    dealt = session.spread(rows)
    assert dealt.select(F.spark_partition_id().alias("p")).distinct().count() == min(cores, 1000)
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))
    many = spark.range(1000).repartition(4 * cores)
    assert session.spread(many) is many
    empty = spark.read.schema("id long").parquet(f"{tmp_path}/one").where("id < 0")
    assert session.spread(empty).count() == 0
