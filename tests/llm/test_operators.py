"""Each operator against brute force, on a table of hard cases; and empty tables, nulls and repeated rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from merchantry.llm import archive, components, decontaminate, line_runs, mixing, ngram_join, pairwise_quality, pii, quality_rules, token_scan, toxicity, vectors
from merchantry.session import new_folder
from tests.llm import brute
from tests.llm.conftest import sentence

TEXTS = st.lists(st.text(alphabet="ab C\n\t é\x1c\x85", max_size=40), max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_shingles(texts):
    found, at = [], []
    for piece in vectors.pieces(pa.array(texts, pa.string())):
        w = vectors.words(piece, lower=True)
        found += [(piece.first + t, bytes(piece.data[a:b]).decode()) for t, a, b in zip(w.text, w.starts, w.ends, strict=True)]
        at += vectors.shingle_sets(w)
    expected = [(i, w) for i, t in enumerate(texts) for w in brute.words(t)]
    assert found == expected
    assert [len(s) for s in at] == [len(brute.shingles(t)) for t in texts]
    sets = [brute.shingles(t) for t in texts]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(np.intersect1d(at[i], at[j])) == len(a & b)


def thue_morse(letters):
    """A text of 1024 of two letters; with the letters swapped it has the same sum of any powers modulo 2^64."""
    return "".join(letters[i.bit_count() % 2] for i in range(1024))


def test_texts_that_collide_in_a_polynomial_hash(spark):
    one, two = thue_morse("ab"), thue_morse("ba")
    rows = spark.createDataFrame([(1, f"w w w w w {one}"), (2, f"w w w w w {two}"), (3, one), (4, two), (5, f"{one}\n{two}\n{one}")], "doc_id long, text string")
    assert {r.n_deleted for r in line_runs.delete_runs(rows.where("doc_id < 3")).collect()} == {0}
    assert {r.doc_id: r.component_id for r in ngram_join.near_duplicates(rows.where("doc_id in (3, 4)")).collect()} == {3: 3, 4: 4}
    assert quality_rules.features(rows.where("doc_id = 5")).first().n_dup_lines == 1
    items = rows.where("doc_id = 4").withColumnRenamed("doc_id", "item_id")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find(rows.where("doc_id in (3, 4)"), items).collect()] == [(4, 4)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=70), min_size=1, max_size=8))
def test_hashes_follow_the_bytes(parts):
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    got = vectors.hashes(data, ends - [len(p) for p in parts], ends)
    assert all((got[i] == got[j]) == (parts[i] == parts[j]) for i in range(len(parts)) for j in range(i))


# 1 -------------------------------------------------------------------------------------------------------------------


def test_mixing(docs, rows):
    got = sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.copies) for r in mixing.plan(docs).collect())
    assert got == sorted((d, n, s, round(t, 6), c) for d, n, s, t, c in brute.mix([(d, t, s) for d, t, _, s, _ in rows]))
    assert all(c <= 2 for *_, c in got)
    assert got == sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.copies) for r in mixing.plan(docs.repartition(3)).collect())


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randint(1, 80)), f"s{i % 4}") for i in range(800)]
    got = mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 160 for r in got)


def test_mixing_repeats_rows(docs, rows, nothing):
    taken = {d: c for d, _, _, _, c in brute.mix([(d, t, s) for d, t, _, s, _ in rows])}
    out = mixing.sample(docs)
    assert out.columns == [*docs.columns, "copy_no_"]
    assert {r.copy_no for r in out.select("copy_no").collect()} == {8}
    assert Counter(r.doc_id for r in out.collect()) == Counter({d: c for d, c in taken.items() if c})
    assert mixing.plan(nothing).count() == 0 and mixing.sample(nothing).count() == 0


def test_mixing_of_empty_texts_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "x", "b")], "doc_id long, text string, source string")
    got = mixing.plan(rows).collect()
    assert len(got) == 5 and all(r.taken == r["size"] * r.copies for r in got)
    assert {r.target for r in got if r.source_size == 0} == {0.0}


# 2 -------------------------------------------------------------------------------------------------------------------

HARD = [
    "a@b@c.d x@y.z_q@r.s", "\U0001f600 é a.b@c.de 1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.4", "4111 1111 1111 1111x +1 (234) 555-1234 5", None, "",
    "9" * 5000, "1 " * 4000, "a" * 20000 + "@b", "+" * 100 + "1 2 3 4 5 6 7 8 9", "a@b.c@d.e-@f..g.h", "4111-1111-1111-1111 12345", "+1 234\n567 890 12",
]


def test_pii_base_entities(spark, docs):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    got = {r.doc_id: r for r in pii.find(rows).collect()}
    for r in rows.collect():
        found = brute.entities(r.text)
        spans = ",".join(f"{k}:{a}:{b}" for k in brute.BASE for a, b in found[k])
        g = got[r.doc_id]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(len(found[k]) for k in brute.BASE)
        assert g.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) <= set(g.spans.split(",")) or not spans


def test_pii_discovers_by_context(spark):
    rows = [(i, f"call my phone: +1 (2{i}4) 555-12{i}4 now") for i in range(10, 20)]
    rows += [(100, "zz my phone: (415) 555-9876 ok"), (101, "in the (415) 555-9871 ok"), (100, "zz my phone: (415) 555-9876 ok"), (None, "my phone: (415) 555-9000")]
    got = [(r.doc_id, r.spans, r.n_phone) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("n_discovered > 0").collect()]
    assert sorted(got, key=str) == sorted([(100, "phone:13:27", 0), (100, "phone:13:27", 0), (None, "phone:10:24", 0)], key=str)


def test_pii_discovers_beside_base_entities_and_in_chains(spark):
    rows = [(i, f"call my phone: +1 (2{i}4) 555-12{i}4 now") for i in range(10, 20)]
    rows += [(i, f"write to my inbox: user{i}@example.com now") for i in range(20, 30)]
    rows += [(100, "my inbox: john(at)example.com ok"), (101, "my inbox: eve[at]site.org ok")]
    rows += [(102, "my phone: 020-7946-0958 a@b.com"), (103, "my phone: 5551234567 20241128 77"), (104, "my phone: 020 7946 0958 ok")]
    # Beside a base entity: the words before the second number are the first address, in all texts.
    rows += [(i, f"mail a@b.com +1 (2{i}4) 555-12{i}4 now") for i in range(30, 40)] + [(105, "mail a@b.com 020-7946-0959")]
    got = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("n_discovered > 0").collect()}
    assert got == {
        100: "email:10:29", 101: "email:10:25", 102: "email:24:31,phone:10:23", 103: "phone:10:20", 104: "phone:10:23", 105: "email:5:12,phone:13:26",
    }


def test_pii_of_long_texts(spark):
    """Texts with 200 000 matches: base entities between mentions, one chain of mentions, and chains cut by entities."""
    rows = [(1, "12, " * 200_000), (2, "1 " * 200_000), (3, "a1@b.co 12 " * 100_000), (4, "x 1.2.3.4 y12 " * 60_000)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [got[i].n_email for i in (1, 2, 3, 4)] == [0, 0, 100_000, 0] and got[4].n_ip == 60_000
    spans = ",".join(f"email:{11 * i}:{11 * i + 7}" for i in range(100_000))
    assert got[3].spans == spans and got[3].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()


def test_pii_rounds_reach_a_fixed_point(spark):
    """Numbers of each layer stand after the words of two layers, so confidence goes from layer to layer."""
    words = ("alpha beta", "gamma delta", "eps zeta", "eta theta", "iota kappa", "lam mu")
    texts = [f"ring alpha beta +49 30 1234{i}678 end" for i in range(12)]
    for layer, size in enumerate((10, 8, 7, 6, 5)):
        texts += [f"ring {words[layer + k]} 0{layer}0-55{i}1-77{layer}9 end" for i in range(size) for k in (0, 1)]
    texts += [f"ring lam mu word{i} end" for i in range(30)]
    rows = list(enumerate(texts))
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where("n_discovered > 0").collect()
    expected = brute.bootstrapped(rows)
    assert {r.doc_id for r in found} == expected and len(expected) > 50


def test_pii_of_nothing(nothing):
    assert pii.find(nothing).count() == 0


# 3 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [6, 100, 32768])
def test_token_counts(spark, docs, rows, block):
    folder = token_scan.write_tokens(docs.union(docs.where("doc_id = 24").withColumn("doc_id", F.lit(None).cast("long"))), new_folder(spark, "tokens"))
    with open(token_scan.VOCABULARY, "rb") as f:
        encode = token_scan._encoding(0, f.read()).encode_ordinary
    expected = Counter({(d, len(encode(t or ""))): 1 for d, t, *_ in rows}) + Counter({(None, len(encode(next(t for d, t, *_ in rows if d == 24)))): 1})
    assert Counter((r.doc_id, r.n_tokens) for r in token_scan.count(spark, folder, block_tokens=block).collect()) == expected
    bare = token_scan.count(spark, folder, n_header=0, block_tokens=block).collect()
    assert Counter(r.n_tokens - token_scan.HEADER for r in bare) == Counter(n for _, n in expected.elements())
    per_file = defaultdict(list)
    for r in bare:
        per_file[r.path].append(r.ordinal)
    assert all(sorted(v) == list(range(len(v))) for v in per_file.values())


def test_token_counts_of_one_file_read_by_many_tasks(spark, docs, rows, monkeypatch):
    folder = token_scan.write_tokens(docs.coalesce(1), new_folder(spark, "tokens of one file"))
    monkeypatch.setattr(token_scan, "TASK_BYTES", 4000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")  # no file is read as one value
    try:
        got = token_scan.count(spark, folder, block_tokens=500)
        assert len({r.path for r in got.collect()}) == 1
        whole = token_scan.count(spark, folder)
        assert sorted(map(str, got.collect())) == sorted(map(str, whole.collect())) and whole.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_token_counts_of_nothing(spark, nothing):
    folder = token_scan.write_tokens(nothing, new_folder(spark, "tokens"))
    assert token_scan.count(spark, folder).count() == 0


def test_tokens_after_the_last_separator(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(np.array([5, 6, 0, 0, 7], "<u2").tobytes())
    got = [(r.ordinal, r.n_tokens) for r in token_scan.count(spark, str(tmp_path), n_header=0, block_tokens=6).orderBy("ordinal").collect()]
    assert got == [(0, 2), (1, 0), (2, 1)]


# 4 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [ngram_join.BLOCK_ITEMS, 60])
def test_ngram_join(docs, rows, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, block_items=block).collect()}
    assert got == brute.components([(d, t) for d, t, *_ in rows])


def test_ngram_join_of_near_copies_in_blocks(spark):
    rng = random.Random(3)
    base = [sentence(rng, 1) for _ in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 8])):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        # sets of several levels of sizes, of which neighbouring ones link
        rows.append((i, " ".join(w[: rng.choice([120, 120, 112, 96, 80, 64])])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_items=700).collect()}
    assert got == brute.components(rows)


def test_ngram_join_of_nulls_and_nothing(spark, nothing):
    assert ngram_join.near_duplicates(nothing).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e"), (7, "A b c d e"), (7, "A b c d e"), (None, "f g"), (5, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(rows).collect())
    assert got == Counter({(None, 1, 7): 1, (7, 1, 7): 2, (None, 1, None): 1, (5, 0, 5): 1})
    assert sorted(str(r.doc_id) for r in ngram_join.one_of_each(rows).collect()) == ["5", "7", "None", "None"]


def test_trie_links_are_exact():
    rng = random.Random(2)
    for _ in range(150):
        bases = [rng.sample(range(200), rng.randint(1, 40)) for _ in range(rng.randint(1, 4))]
        sets = []
        for _ in range(rng.randint(2, 20)):
            s = set(rng.choice(bases)) | {rng.randint(0, 400) for _ in range(rng.randint(0, 4))}
            sets.append(np.array(sorted(rng.sample(sorted(s), max(1, len(s) - rng.randint(0, 4)))), np.int64))
        label = ngram_join.link_components(sets)
        top = list(range(len(sets)))

        def root(x, top=top):
            while top[x] != x:
                x = top[x]
            return x

        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    top[root(i)] = root(j)
        assert all((root(i) == root(j)) == (label[i] == label[j]) for i in range(len(sets)) for j in range(i))


def test_components_of_a_long_path(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
    assert components.components(links.limit(0)).count() == 0


# 5 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 300])
def test_decontamination(spark, docs, rows, block):
    rng = random.Random(9)
    items = [(i, " ".join(t.split()[a : a + n])) for i, (t, a, n) in enumerate((rows[k][1], rng.randint(0, 5), rng.randint(5, 40)) for k in range(8, 40))]
    items += [(100, None), (101, ""), (102, "one"), (103, "ONE two three four"), (104, "two three"), (105, sentence(rng, 30)), (0, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = Counter((r.doc_id, r.item_id, r.n_item, r.n_shared) for r in decontaminate.find(docs, bench, block_bytes=block).collect())
    assert got == Counter(brute.contained([(d, t) for d, t, *_ in rows], items)) and len(got) > 20
    hit = {d for d, *_ in got}
    assert sorted(r.doc_id for r in decontaminate.remove(docs, bench).collect()) == [d for d, *_ in rows if d not in hit]


def test_decontamination_of_nothing(spark, docs, nothing):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs, bench).count() == 0 and decontaminate.remove(docs, bench).count() == docs.count()
    assert decontaminate.find(nothing, spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


# 6 -------------------------------------------------------------------------------------------------------------------


def test_quality_counts(spark, docs, rows):
    labels = spark.createDataFrame([(d, 1) for d, *_ in rows] + [(None, 1), (10**9, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for d, t, *_ in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.counts(t)
        assert r.base_failed == brute.base_failed(t)
        assert r.kept == (not r.base_failed)  # too few labels for any cutoff
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, t, *_ in rows if not brute.base_failed(t)]


def test_quality_cutoffs_reject_junk(spark):
    rng = random.Random(4)
    good = [(i, sentence(rng, 50), 1) for i in range(900)]
    bad = [(1000 + i, " ".join(w + "###" for w in sentence(rng, 50).split()), 0) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    judged = quality_rules.judge(rows.drop("quality"), rows.drop("text")).join(rows.select("doc_id", "quality"), "doc_id").collect()
    assert all(r.kept == (r.quality == 1) for r in judged)


def test_binomial_bound_is_exact():
    for k, n, e in ((0, 100, 0.05), (3, 50, 0.01), (10, 20, 0.2)):
        p = quality_rules.upper_bound(k, n, e)
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(tail, e, rel_tol=1e-6)
    assert quality_rules.upper_bound(5, 5, 0.1) == 1
    # a cutoff stands only while the bound holds; later ones are not tried after a failure
    good = {0: 5000}
    rejected = {(0, "symbol_ratio", j): (0 if j < 3 else 500) for j in range(11)}
    assert quality_rules.choose_cutoffs(good, rejected, 0.05, 0.05)[0]["symbol_ratio"] == quality_rules.RULES["symbol_ratio"][2]
    assert quality_rules.choose_cutoffs({0: 50}, {}, 0.05, 0.05) == {}


def test_quality_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(nothing, labels).count() == 0 and quality_rules.keep(nothing, labels).count() == 0


# 7 and 8 -------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=6), min_size=1, max_size=6, unique=True), st.text("abcde", max_size=7))
def test_levenshtein_automaton(terms, word):
    assert sorted(toxicity.Automaton(terms).within_one(word)) == sorted(t for t in terms if brute.edits(t, word) <= 1)


def piece_of(text):
    return next(vectors.pieces(pa.array([text])))


def test_misspelled_and_quoted_terms():
    lexicon = toxicity.Lexicon({"stupid": 4.0}, {"bocom": 3.0}, {"stupid"}, before={"you": 2.0, "wrote": -2.0}, after={"wrote": -2.0})
    plain = toxicity.text_sums(lexicon, piece_of("some stupid thing"))[0]
    assert toxicity.text_sums(lexicon, piece_of("some st*pid thing"))[0][0] == pytest.approx(math.log1p(3.2))
    assert toxicity.text_sums(lexicon, piece_of("Some STUPIDD!!! thing"))[0][1] == pytest.approx(math.log(2))
    assert toxicity.text_sums(lexicon, piece_of("a Bocomente b"))[0][0] == pytest.approx(math.log1p(3.0))
    assert toxicity.text_sums(lexicon, piece_of("they said \"some stupid thing\" then"))[0][0] < plain[0] < toxicity.text_sums(lexicon, piece_of("you stupid thing"))[0][0]
    assert toxicity.text_sums(lexicon, piece_of("stapled cupid"))[0][1] == 0
    assert toxicity.text_sums(lexicon, piece_of("stupid things I wrote"))[0][0] == pytest.approx(math.log1p(4 * toxicity.QUOTED))
    assert toxicity.text_sums(lexicon, piece_of("stupid one two three four five six seven wrote"))[0][0] == pytest.approx(math.log1p(4 * toxicity.QUOTED))
    assert toxicity.text_sums(lexicon, piece_of("stupid one two three four five six seven eight wrote"))[0][0] == pytest.approx(math.log1p(4))
    both = next(vectors.pieces(pa.array(["you", "stupid you", None, "wrote"])))  # neighbours are those of the same text
    assert toxicity.text_sums(lexicon, both)[1][0] == pytest.approx(math.log1p(4))


def test_telling_terms_against_all_counts(spark):
    rng = random.Random(5)
    rows = [(y, sorted({w for w in "abcdefgh" if rng.random() < (0.9 if w == "a" and y else 0.9 if w == "b" and not y else 0.2)})) for y in (0, 1) for _ in range(60)]
    rows += [(1, ["rare"]), (1, ["rare"]), (0, [])]
    found = {r.term: (r.t, r.c, r.x) for r in toxicity._telling(spark.createDataFrame(rows, "label int, terms array<string>"), 4, 0.05).collect()}
    size, terms, want = [sum(y == v for y, _ in rows) for v in (0, 1)], {w for _, ws in rows for w in ws}, {}
    for w in terms:
        c, t = (sum(y == v and w in ws for y, ws in rows) for v in (0, 1))
        p, n = size[1] / sum(size), t + c
        chance = math.exp(-sum(k * math.log(k / (n * q)) for k, q in ((t, p), (c, 1 - p)) if k)) * len(terms)
        if max(t, c) >= 4 and chance <= 0.05:
            want[w] = t, c, pytest.approx(math.log((t + 0.5) / (size[1] + 1) / ((c + 0.5) / (size[0] + 1))))
    assert found == want and {"a", "b"} <= set(want)
    assert toxicity._telling(spark.createDataFrame([(1, ["a"])] * 9, "label int, terms array<string>"), 4, 0.05).count() == 0


def test_context_is_learnt_from_labels(spark):
    rows = [(i, f"b{i} listen moron you go c{i}", 1) for i in range(60)]
    rows += [(100 + i, f"b{i} the report mentions moron as noun c{i}", 0) for i in range(12)]
    rows += [(200 + i, f"plain b{i} here c{i}", 0) for i in range(400)]
    lexicon, _ = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), 0.1, least_log_ratio=2.0)
    assert {"moron"} <= set(lexicon[0])
    before, after = lexicon[4:]
    assert before["report"] < 0 < before["listen"] and after["noun"] < 0 < after["you"] and not any(w[0] in "bc" and w[1:].isdigit() for w in (*before, *after))
    total = lambda text: toxicity.text_sums(toxicity.Lexicon(*lexicon), piece_of(text))[0][0]
    assert total("report mentions moron today") < total("today moron here") < total("listen moron today")


def test_long_words_are_learnt(spark):
    word = "schimpf" * 30
    rows = [(i, f"b{i} {word} x{i}", 1) for i in range(25)] + [(100 + i, f"b{i} x", 0) for i in range(25)]
    assert word in toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), 0.5)[0][0]


def test_copies_are_no_evidence_for_terms(spark):
    text = "odd words of one text stand here and go on for a while until it ends"
    rows = [(i, text, 1) for i in range(20)] + [(30 + i, f"scum {'abcdefgh'[i]} b c d e", 1) for i in range(8)] + [(100 + i, f"b {i} x", 0) for i in range(60)]
    rows += [(200, None, 1), (201, "", 1), (202, text, 0), (203, "scum", 1), (204, "scum", 1), (29, text + " now", 1)]
    left = toxicity.apart(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    ids = {r.doc_id for r in left.collect()}
    assert {0, 200, 202, 203, *range(30, 38)} <= ids and not ids & {*range(1, 20), 201, 204}
    words, _ = toxicity.learn_terms(left, 4, 1.0)
    assert "scum" in words and not {"odd", "while", "stand"} & set(words)
    assert toxicity.apart(left.where("false")).count() == 0


def test_clean_near_words_leave_the_terms_fuzzy(spark):
    rows = [(i, f"tall moron and scum b{i}x here", 1) for i in range(25)] + [(100 + i, f"tall oron and here c{i}x", 0) for i in range(25)]
    model, _ = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"), 0.5)
    lexicon = toxicity.Lexicon(*model)
    hits = lambda text: toxicity.text_sums(lexicon, piece_of(text))[0][1] > 0
    assert all(hits(f"tall {w} here") for w in ("moron", "m0ron", "miron", "s-cum", "skum"))
    assert not any(hits(f"tall {w} here") for w in ("oron", "and"))


@pytest.mark.parametrize(("module", "label", "folds", "held_out", "least"), [(toxicity, "toxic", 3, 1, 0.93), (pairwise_quality, "quality", 4, 2, 0.95)])
def test_held_out_accuracy(spark, module, label, folds, held_out, least):
    import zlib

    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    scored = module.score(docs.withColumn("score", F.lit("x")).withColumn("label", F.lit(1)), labels)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held_out) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[label] for r in out) / len(out) >= least


def brute_quality(x, label, ridge=1e-3):
    """Scores of rows of features: every pair of a good and a bad learnt row listed (label None: not learnt from), the middle
    between two strengths in order as the cut."""
    learnt, y = x[[v is not None for v in label]], np.array([v for v in label if v is not None])
    z, all_z = (np.clip((m - learnt.mean(0)) / np.maximum(learnt.std(0), 1e-6), -8, 8) for m in (learnt, x))
    pairs = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(pairs @ w))
        hessian = (pairs * (p * (1 - p))[:, None]).T @ pairs / len(pairs) + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, pairs.T @ p / len(pairs) - ridge * w)
    ordered, n_bad = np.sort(z @ w), (y == 0).sum()
    cut = (ordered[n_bad - 1] + ordered[n_bad]) / 2
    return 1 / (1 + 3 / 7 * np.exp(-(all_z @ w - cut) / (z @ w)[y == 1].std()))


def noisy_texts(n, seed, words):
    """Texts whose labels follow their symbols and shouts only in part."""
    rng = random.Random(seed)
    for i in range(n):
        bad = rng.random() < 0.3
        odd = rng.choice([0, 0, 1, 3]) + 2 * bad
        tail = " ".join(rng.choice(["!!", "#", "| x", "SHOUT", "ab"]) for _ in range(rng.randint(0, odd)))
        yield i, f"{sentence(rng, rng.randint(*words))}\n{tail}", 1 - (bad if rng.random() < 0.9 else not bad)


def test_quality_is_learnt_from_every_pair(spark):
    import zlib

    rows = list(noisy_texts(160, 3, (1, 40)))
    rows += [rows[4], rows[4], (900, None, 0), (901, "", 1), (None, "no id", 1)]
    labels = [(i, v) for i, _, v in rows[:150]] + [(900, 0), (901, 1), (5, 1 - rows[5][2]), (None, 1), (7777, 0), (8, None), (9, 2)]
    given = defaultdict(list)
    for i, v in labels:
        if i is not None and v in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2:
            given[i].append(v)
    expanded = [(i, t, v) for i, t, _ in rows for v in given.get(i) or [None]]  # of several labels each counts
    x = np.concatenate([pairwise_quality.feature_matrix(p) for p in vectors.pieces(pa.array([t for _, t, _ in expanded], pa.string()))])
    expected = {(i, t): s for (i, t, _), s in zip(expanded, brute_quality(x, [v for *_, v in expanded]), strict=True)}
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    for table in (docs, docs.repartition(7)):
        got = pairwise_quality.score(table, marks).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
        for r in got:
            assert r.score == pytest.approx(next(s for (i, _), s in expected.items() if i == r.doc_id), abs=2e-5)


def test_quality_cut_counts_all_labelled_documents(spark):
    """With more documents of a label than any sample held, as many of them are under the cut, or at it, as are bad."""
    import zlib

    rows = [r for r in noisy_texts(18000, 8, (3, 12)) if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    assert sum(r[2] for r in rows) > 8000
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    scored = pairwise_quality.score(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    assert scored.where("score < 0.7").count() <= sum(r[2] == 0 for r in rows) <= scored.where("score <= 0.7").count()


def test_cut_between_strengths(spark):
    values = [-0.0, 0.0, 1e-300, -1e-300, 2.5, 2.5, 2.5, -7.25, -7.250000001, 1e9, -1e9, 3.0]
    learnt = spark.createDataFrame([(1, [v]) for v in values], "label int, x array<double>").repartition(3)
    ordered = sorted(values)
    for rank in range(1, len(values)):
        assert pairwise_quality.cut_between(learnt, lambda x: x[:, 0], rank) == (ordered[rank - 1] + ordered[rank]) / 2


@pytest.mark.parametrize(("module", "label", "value"), [(toxicity, "toxic", 0.0), (pairwise_quality, "quality", 0.5)])
def test_scores_without_labels(spark, docs, nothing, module, label, value):
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    odd = spark.createDataFrame([(None, 1), (0, None), (3, 7)], f"doc_id long, {label} int")
    for labels in (none, odd):
        assert {r.score for r in module.score(docs, labels).collect()} == {value}
    assert module.score(nothing, odd).count() == 0


# 9 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("least", [1, 5, 12])
def test_line_runs(docs, rows, least):
    gone = brute.deleted_lines([(d, t) for d, t, *_ in rows], least)
    got = line_runs.delete_runs(docs, min_words=least)
    assert got.columns == [*docs.columns, "n_lines_", "n_deleted_"]
    for r in got.collect():
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        assert r.text == brute.without_lines(text, gone.get(r.doc_id)) and r.n_deleted == 9 and r.n_deleted_ == len(gone.get(r.doc_id, ()))
        assert r.n_lines_ == sum(bool(brute.words(x)) for x in (text or "").split("\n"))


def test_line_runs_of_short_lines(spark):
    texts = ["a b\nc\nd e\nq", "x\na b\n\nc\nd e\ny", "a b\nc\nz", "c\nd e", "a b\nc\nd e\na b\nc\nd e"]
    rows = list(enumerate(texts))
    gone = brute.deleted_lines(rows, 5)
    got = {r.doc_id: r.text for r in line_runs.delete_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: brute.without_lines(t, gone.get(d)) for d, t in rows} and got[1] == "x\n\ny"


def test_line_runs_of_nulls_and_repeats(spark, nothing):
    assert line_runs.delete_runs(nothing).count() == 0
    line = "one two three four five"
    rows = [(1, line), (1, line), (None, line), (2, None), (2, line + "\n" + line)]
    got = Counter((r.doc_id, r.text, r.n_deleted) for r in line_runs.delete_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(None, line, 0): 1, (1, "", 1): 2, (2, None, 0): 1, (2, "", 2): 1})


# 10 ------------------------------------------------------------------------------------------------------------------


def test_archive_round_trip(spark):
    big, other = "x" * 100, "é" * 60
    pages = [(3, "u3", big), (1, "u1\r\nWARC-Type: fake", big), (2, "u2", "small"), (4, None, "small"), (5, "u5", None), (6, "u6", other), (7, "u7", other + "\r\n\r\nWARC/1.1"), (None, "n", big), (8, "u8", other)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("length", F.lit(2))
    got = {r.page_id: r for r in archive.round_trip(table).collect()}
    assert len(got) == len(pages)
    for i, _, html in pages:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 4: ("response", None), 5: ("response", None),
        6: ("response", None), 8: ("revisit", 6), 7: ("response", None),
    }
    folder = archive.write(table, new_folder(spark, "archive"))
    assert spark.read.parquet(f"{folder}/payloads").count() == 5
    whole = archive.read(spark, folder)
    for r in whole.select("page_id", archive.record_bytes().alias("b")).collect():
        head, _, body = bytes(r.b).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        html = next(h for i, _, h in pages if i == r.page_id)
        assert body == (b"" if got[r.page_id].record_type == "revisit" else (html or "").encode()) + b"\r\n\r\n"
        assert int(fields[b"Content-Length"]) == len(body) - 4


def test_archive_of_nothing_and_of_damage(spark, tmp_path):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert archive.round_trip(table).count() == 0
    folder = archive.write(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), str(tmp_path / "a"))
    spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.encode(F.lit("abd"), "UTF-8")).write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(f"{folder}/records").write.parquet(str(tmp_path / "b/records"))
    assert [r.verified for r in archive.read(spark, str(tmp_path / "b")).collect()] == [False]
