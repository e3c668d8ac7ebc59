"""Toxicity scores from a lexicon that also meets misspelled terms (7).

The lexicon is learnt from labelled documents: whole words, and stems that begin words, which toxic documents hold much
more often than others. A word of a text hits the lexicon as it is, by its beginning, or misspelled: a Levenshtein
automaton of the word, for one edit, walks the trie of the terms, and each term on which both accept is a hit. Only words
that share a term's first or second half can be one edit away, which a hash of either half finds beforehand. Words of
labelled clean documents are no misspellings, only they themselves are left out; every whole word of the lexicon is met misspelled.

Of documents that share their least hash of five words in a row, which copies and near copies mostly do, one is learnt
from, so that copies do not make rare words terms. No count of terms and no length of words limits the lexicon; the size
of the sample does.

Around each hit a window of text is read. Quotation marks around it make it a quotation, which counts less. Words before
and after hits are learnt from the documents with hits, where their share of toxic ones cannot be chance (the Chernoff
bound of the binomial tail, times the number of words, is under `error`): those beside hits of clean documents make a hit
quotation, those beside hits of toxic ones abuse, which counts more. A logistic model, fitted to the same bounded sample,
turns a text's sums into a score.

Defined results: null and empty texts have no hits and the score of a text without any; repeated rows are scored each;
null ids are not held out; without toxic or without clean labels every score is 0; without hits in documents of both labels no context is learnt; an empty table has no scores; other
columns are ignored, also for the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merchantry.llm import vectors
from merchantry.llm.learning import fold, labelled_sample, logistic, sigmoid
from merchantry.session import cut, ship_package

CUT = 0.7
WINDOW = 60  # bytes to either side in which marks are looked for
BESIDE = 8  # words to either side that are context
QUOTED, ABUSE, MISSPELLED = 0.3, 1.2, 0.8
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_OPEN = re.compile('["“«„‘][^"”»“’]*$')
_CLOSE = re.compile('^[^"“«„‘]*["”»’]')


class Tokens(NamedTuple):
    data: np.ndarray
    sums: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def tokens(piece: vectors.Piece) -> Tokens:
    """Words with A-Z lower-cased and their outer non-letters cut off; marks within a word stay."""
    data = vectors._LOWER[piece.data]
    starts, ends = vectors.edges(~vectors._SPACE[data], piece.offsets)
    place = np.arange(len(data))
    letter = _LETTER[data]
    following = np.minimum.accumulate(np.where(letter, place, len(data))[::-1])[::-1]
    preceding = np.maximum.accumulate(np.where(letter, place, -1))
    a, b = (following[starts], preceding[ends - 1] + 1) if len(starts) else (starts, ends)
    has = a < b
    a, b = a[has], b[has]
    return Tokens(data, vectors.prefix_sums(data), a, b, np.searchsorted(piece.offsets, a, "right") - 1)


class Automaton:
    """A trie of terms that Levenshtein automata for one edit walk."""

    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        for term in terms:
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term

    def within_one(self, word: str) -> list[str]:
        """The terms at distance 0 or 1. Bit i of a state: i characters of the word are used up."""
        n, of = len(word), {}
        for i, c in enumerate(word):
            of[c] = of.get(c, 0) | 1 << i
        found, stack = [], [(self.root, 1, 2)]
        while stack:
            node, none, one = stack.pop()
            for c, child in node.items():
                if c == "":
                    if (none | one) >> n & 1:
                        found.append(child)
                    continue
                hit = of.get(c, 0)
                none_next = (none & hit) << 1
                one_next = ((one & hit) << 1 | none | none << 1 | none_next << 1) & (2 << n) - 1
                if none_next | one_next:
                    stack.append((child, none_next, one_next))
        return found


class Lexicon:
    """Terms with weights; find() has the hits of a piece of texts."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], fuzzy: set[str], clean: frozenset[str] = frozenset(), before: dict[str, float] | None = None, after: dict[str, float] | None = None) -> None:
        """clean: words that are no misspellings of the fuzzy terms; before, after: words beside hits, with log ratios."""
        self.words, self.stems, self.fuzzy, self.clean = words, stems, fuzzy, clean
        self.automaton = Automaton(sorted(fuzzy))
        self.exact = self._table({w: x for w, x in words.items()})
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in {len(s.encode()) for s in stems}:
            self.by_length[size] = self._table({s: x for s, x in stems.items() if len(s.encode()) == size})
        self.heads, self.tails = {}, {}
        for kind, halves in ((self.heads, [t[: len(t) // 2] for t in fuzzy]), (self.tails, [t[len(t) // 2 :] for t in fuzzy])):
            for half in halves:
                kind.setdefault(len(half.encode()), {})[half] = 1.0
        self.heads = {k: self._table(v)[0] for k, v in self.heads.items()}
        self.tails = {k: self._table(v)[0] for k, v in self.tails.items()}
        sizes = [len(t.encode()) for t in fuzzy] or [0]
        self.bounds = min(sizes) - 4, max(sizes) + 4
        self.memo: dict[int, float] = {}
        self.sides = [(step, self._table(side)) for step, side in ((-1, before), (1, after)) if side]

    @staticmethod
    def _table(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        rows = []
        for term, x in values.items():
            data = np.frombuffer(term.encode(), np.uint8)
            rows.append((vectors.range_hashes(vectors.prefix_sums(data), np.zeros(1, np.int64), np.full(1, len(data)))[0], x))
        rows.sort(key=lambda r: int(r[0]))
        return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows])

    @staticmethod
    def _look(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Place in the sorted table, or -1."""
        if not len(table):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
        return np.where(table[at] == hashes, at, -1)

    def near(self, t: Tokens) -> np.ndarray:
        """Numbers of the tokens that may be one edit from a fuzzy term."""
        size = t.ends - t.starts
        some = np.flatnonzero((size >= max(self.bounds[0], 1)) & (size <= self.bounds[1]))
        out = np.zeros(len(some), bool)
        for tables, head in ((self.heads, True), (self.tails, False)):
            for n, table in tables.items():
                fit = np.flatnonzero(size[some] >= n)
                a = t.starts[some[fit]] if head else t.ends[some[fit]] - n
                out[fit] |= self._look(table, vectors.range_hashes(t.sums, a, a + n)) >= 0
        return some[out]

    def find(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the tokens that hit."""
        weight = np.zeros(len(t.starts))
        at = self._look(self.exact[0], hashes := vectors.range_hashes(t.sums, t.starts, t.ends))
        weight[at >= 0] = self.exact[1][at[at >= 0]]
        for n, (table, values) in self.by_length.items():
            fit = np.flatnonzero(t.ends - t.starts >= n)
            at = self._look(table, vectors.range_hashes(t.sums, t.starts[fit], t.starts[fit] + n))
            fit, at = fit[at >= 0], at[at >= 0]
            weight[fit] = np.maximum(weight[fit], values[at])
        if self.fuzzy:
            if len(self.memo) > 1_000_000:
                self.memo.clear()
            for i in self.near(t):
                key = int(hashes[i])
                if weight[i] == 0 and key not in self.memo:
                    word = t.data[t.starts[i] : t.ends[i]].tobytes().decode("utf-8", "replace")
                    near = [] if word in self.clean else self.automaton.within_one(word)
                    self.memo[key] = MISSPELLED * max([0.0, *(self.words[m] for m in near)])
                if weight[i] == 0:
                    weight[i] = self.memo[key]
        hit = np.flatnonzero(weight)
        return hit, weight[hit]

    def leaning(self, t: Tokens, hit: np.ndarray) -> np.ndarray:
        """Summed log ratios of the words beside each hit, within its text."""
        lean = np.zeros(len(hit))
        for step, (table, values) in self.sides:
            for far in range(1, BESIDE + 1):
                j = hit + step * far
                own = np.flatnonzero((j >= 0) & (j < len(t.starts)))
                own = own[t.text[j[own]] == t.text[hit[own]]]
                at = self._look(table, vectors.range_hashes(t.sums, t.starts[j[own]], t.ends[j[own]]))
                lean[own[at >= 0]] += values[at[at >= 0]]
        return lean


def quoted(data: np.ndarray, start: int, end: int, lo: int, hi: int) -> bool:
    """Whether quotation marks stand around start..end within its text lo..hi."""
    text = lambda a, b: data[a:b].tobytes().decode("utf-8", "ignore")
    return bool(_OPEN.search(text(max(lo, start - WINDOW), start)) and _CLOSE.search(text(end, min(hi, end + WINDOW))))


def text_sums(lexicon: Lexicon, piece: vectors.Piece) -> np.ndarray:
    """For each text: summed weights in context, log of hits, greatest weight, hits a root of words, and one."""
    t = tokens(piece)
    hit, weight = lexicon.find(t)
    text = t.text[hit]
    bounds = np.log([QUOTED, ABUSE])
    factor = np.exp(np.clip(lexicon.leaning(t, hit), *bounds))
    for j, i in enumerate(hit):
        if quoted(t.data, int(t.starts[i]), int(t.ends[i]), int(piece.offsets[t.text[i]]), int(piece.offsets[t.text[i] + 1])):
            factor[j] = QUOTED
    weight = weight * factor
    total = np.bincount(text, weights=weight, minlength=piece.n)
    hits = np.bincount(text, minlength=piece.n)
    most = np.zeros(piece.n)
    np.maximum.at(most, text, weight)
    words = np.bincount(t.text, minlength=piece.n)
    return np.stack([np.log1p(total), np.log1p(hits), most, total / np.sqrt(words + 10.0), np.log1p(words) / 5, np.ones(piece.n)], 1)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's least hash of five words in a row; texts of fewer words have a hash of all of them, empty ones 0."""
    for batch in batches:
        for piece in vectors.pieces(batch.column(1)):
            least = [int(found[0]) if len(found) else 0 for found in vectors.shingle_sets(vectors.words(piece, lower=True))]
            columns = [c.slice(piece.first, piece.n) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(least, pa.int64())], names=["doc_id", "text", "label", "sketch"])


def apart(sample: DataFrame) -> DataFrame:
    """doc_id, text and label of one document, that of the smallest id, for each label and sketch."""
    found = sample.select("doc_id", "text", "label").mapInArrow(_sketched, "doc_id long, text string, label int, sketch long")
    first = Window.partitionBy("label", "sketch").orderBy("doc_id", "text")
    return cut(found.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("doc_id", "text", "label"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct words, and beginnings of 3 to 7 characters of longer words."""
    for batch in batches:
        for piece in vectors.pieces(batch.column(1)):
            t, rows = tokens(piece), [set() for _ in range(piece.n)]
            for a, b, k in zip(t.starts, t.ends, t.text, strict=True):
                rows[k].add(t.data[a:b].tobytes().decode("utf-8", "replace"))
            for k, found in enumerate(rows):
                rows[k] = ["w" + w for w in found] + ["s" + s for s in {w[:n] for w in found for n in range(3, min(len(w), 8))}]
            yield pa.RecordBatch.from_arrays([batch.column(2).slice(piece.first, piece.n), pa.array(rows, pa.list_(pa.string()))], names=["label", "terms"])


def _telling(rows: DataFrame, least_docs: int, error: float) -> DataFrame:
    """term, t, c, x of the terms that tell the labels apart. rows: label, terms (distinct in a row).

    t and c are the toxic and clean rows with the term, x the log ratio of its shares. Were labels dealt by chance, a term
    would part as it does with a probability of at most exp(-n KL) (Chernoff); that times the number of terms is at most
    `error` for those that are returned.
    """
    size = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    counts = rows.select("label", F.explode("terms").alias("term"))
    counts = cut(counts.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("c")))
    n, many = F.col("t") + F.col("c"), counts.count()
    if not (toxic and clean and many):
        return counts.withColumn("x", F.lit(0.0)).where("false")
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * p))).otherwise(0.0)
    share = toxic / (toxic + clean)
    ratio = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1)))
    sure = part("t", share) + part("c", 1 - share) >= math.log(many / error)
    return counts.where((F.greatest("t", "c") >= least_docs) & sure).withColumn("x", ratio)


def learn_terms(sample: DataFrame, least_docs: int, least_log_ratio: float) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with weights: the log ratio of their shares in toxic and in clean documents."""
    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    counts = sample.select("doc_id", "text", "label").mapInArrow(_terms, "label int, terms array<string>").select("label", F.explode("terms").alias("term"))
    counts = counts.groupBy("term").agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("c"))
    ratio = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("c") + 0.5) / (clean + 1)))
    rows = counts.where(F.col("t") >= least_docs).withColumn("x", ratio).where(F.col("x") >= least_log_ratio).collect()  # of a bounded sample
    stems = {r.term[1:]: r.x for r in rows if r.term[0] == "s"}
    # Of stems one within the other, the longer stays only where it says clearly more.
    stems = {s: x for s, x in stems.items() if not any(stems.get(s[:n], 0) > x - 0.7 for n in range(3, len(s)))}
    return {r.term[1:]: r.x for r in rows if r.term[0] == "w"}, stems


def _beside(lexicon: tuple) -> object:
    """For each text with hits, the distinct words before and after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Lexicon(*lexicon)
        for batch in batches:
            for piece in vectors.pieces(batch.column(1)):
                t, rows = tokens(piece), [set() for _ in range(piece.n)]
                hit = found.find(t)[0]
                for i in hit:
                    for j in range(max(i - BESIDE, 0), min(i + BESIDE + 1, len(t.starts))):
                        if j != i and t.text[j] == t.text[i]:
                            rows[t.text[i]].add(("<" if j < i else ">") + t.data[t.starts[j] : t.ends[j]].tobytes().decode("utf-8", "replace"))
                some = np.unique(t.text[hit])
                labels = batch.column(2).slice(piece.first, piece.n).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([labels, pa.array([sorted(rows[k]) for k in some], pa.list_(pa.string()))], names=["label", "terms"])

    return run


def learn_context(sample: DataFrame, lexicon: tuple, least_docs: int, error: float) -> tuple[dict[str, float], dict[str, float]]:
    """Words before and words after hits, with the log ratio of their shares in toxic and clean documents with hits."""
    held = cut(sample.select("doc_id", "text", "label").mapInArrow(_beside(lexicon), "label int, terms array<string>"))
    rows = _telling(held, least_docs, error).collect()  # of a bounded sample
    before, after = ({r.term[1:]: r.x for r in rows if r.term[0] == side} for side in "<>")
    return before, after


def _near_words(words: dict[str, float], fuzzy: set[str]) -> object:
    """The distinct words that are one edit from a fuzzy term and none themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, seen, tried = Lexicon(words, {}, fuzzy), set(), set()
        for batch in batches:
            for piece in vectors.pieces(batch.column(1)):
                t = tokens(piece)
                for i in lexicon.near(t):
                    word = t.data[t.starts[i] : t.ends[i]].tobytes().decode("utf-8", "replace")
                    if word not in words and word not in tried:
                        tried.add(word)
                        if lexicon.automaton.within_one(word):
                            seen.add(word)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen))], names=["word"])

    return run


def _sums(lexicon: tuple) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Lexicon(*lexicon)
        for batch in batches:
            for piece in vectors.pieces(batch.column(1)):
                x = text_sums(found, piece)
                offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(piece.first, piece.n), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["label", "x"])

    return run


def fit(sample: DataFrame, toxic_share: float, least_docs: int = 4, least_log_ratio: float = 3.0, error: float = 0.05) -> tuple[tuple, np.ndarray] | None:
    """((words, stems, fuzzy terms, clean near-words, words before and after hits), weights) of a bounded sample; None where
    a label is missing."""
    if not 0 < toxic_share < 1:
        return None
    single = apart(sample)
    words, stems = learn_terms(single, least_docs, least_log_ratio)
    fuzzy = set(words)
    near = sample.where("label = 0").select("doc_id", "text", "label").mapInArrow(_near_words(words, fuzzy), "word string")
    clean = frozenset(r.word for r in near.distinct().collect())  # of a bounded sample
    lexicon = (words, stems, fuzzy, clean)
    lexicon = (*lexicon, *learn_context(single, lexicon, least_docs, error))
    rows = sample.select("doc_id", "text", "label").mapInArrow(_sums(lexicon), "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r.label, r.x))  # sums are the same whatever order the rows arrive in
    y, x = np.array([r.label for r in rows], float), np.array([r.x for r in rows])
    weights = logistic(x, y, ridge=1e-4)
    share = y.mean()
    # The sample holds both labels in other shares than the labels do.
    weights[-1] += math.log(toxic_share / (1 - toxic_share)) - math.log(share / (1 - share))
    return lexicon, weights


def _scored(model: tuple[tuple, np.ndarray] | None) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*model[0]) if model else None
        for batch in batches:
            for piece in vectors.pieces(batch.column(1)):
                score = sigmoid(text_sums(lexicon, piece) @ model[1]) if model else np.zeros(piece.n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, most: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs. The model is fitted to at most `most` documents of
    each label, none of the held-out fold."""
    ship_package(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & (fold(F.col(id_col).cast("long"), folds) != held_out))
    toxic_share = known.agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0] or 0.0
    sample = cut(labelled_sample(docs, labels, label_col, folds, held_out, most, id_col, text_col))
    model = fit(sample, toxic_share)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = texts.mapInArrow(_scored(model), "doc_id long, score double")
    out = fold(F.col("doc_id"), folds) == held_out
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
