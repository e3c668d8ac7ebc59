"""Periodic runs of words by longest previous factors (12).

A run [s, e) of period q is a stretch of words in which words q apart are identical, q being its smallest period, that no
neighbouring word extends, of at least `least` words and `times` periods (6 and 4). The runs of a text are found from its
factors:

1. The suffixes of all texts of a piece are ranked by their first 1, 2, 4, ... words. Ranks begin with (text, word), so
   that suffixes of two texts never tie, and a suffix whose words stand nowhere else in its text leaves the sorting. A run
   of the least length repeats 5 words, so texts that repeat no stretch of 4 have none and go no further.
2. The last ranks are the suffix array. The ranks of all lengths answer how far two places agree, forward or backward, in
   as many steps as there are lengths; of neighbours in the suffix array this is the LCP array. Taking suffixes out of
   the array from the last place on leaves, beside each place, the nearest suffixes that begin before it: the greater
   LCP with these two is the longest previous factor.
3. Cutting the text into its longest previous factors gives its LZ blocks. Let a run have period q. From s + q on, the
   text repeats what stands q earlier, so a block that begins in [s + q, e) reaches e. Therefore the run either touches a
   boundary between blocks whose lengths together are over (times - 1) q, or lies strictly inside one block. The first
   kind is found by extending, at each boundary b and for each such q, the agreement of b - q with b and of b with b + q.
   All extensions of a piece, at most two thirds of its words, are made at once.
4. A run strictly inside a block is the copy of one in the block's earlier occurrence. Runs are kept in buckets by their
   starts; blocks are taken in order, each copies the runs inside its source, in order of starts, as some are copies
   themselves.

Words are identical when their bytes are. Texts are rows, worked on where they lie: nothing is shuffled.

Defined results: a null or blank text has no words and no runs; null ids stay null (and are not altered by the query's
rule); repeated rows give a row each; other columns are ignored; an empty table gives an empty one. A text is worked on
whole; memory follows the longest one, about 200 bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchantry.llm.ngram_join import ranges
from merchantry.session import ship_package

#: Words that are ranked together; a longer text is a piece of its own.
PIECE_WORDS = 200_000
Run = tuple[int, int, int]
_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _split_groups(rank: np.ndarray, active: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks after each group of equal rank is ordered by second, and the places whose new group is not alone. active: all
    places of groups of two or more."""
    order = np.argsort(rank[active] * np.int64(len(rank) + 2) + second, kind="stable")
    places, second = active[order], second[order]
    old = rank[places]
    at = np.arange(len(places))
    first = np.ones(len(places), bool)
    first[1:] = old[1:] != old[:-1]
    begins = first.copy()
    begins[1:] |= second[1:] != second[:-1]
    group, part = np.maximum.accumulate(np.where(first, at, 0)), np.maximum.accumulate(np.where(begins, at, 0))
    out = rank.copy()
    out[places] = old + part - group
    alone = begins & np.append(begins[1:], True)
    return out, places[~alone]


def _ranks(symbols: np.ndarray, ends: np.ndarray, shortest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words until all differ, over the texts that may repeat a stretch
    of `shortest` words; and these texts' places. symbols: numbers from 0, none in two texts; ends: the end of each
    place's text."""
    counts = np.bincount(symbols)
    rank = (np.cumsum(counts) - counts)[symbols]
    levels, active, size, places = [rank], np.flatnonzero(counts[symbols] > 1), 1, np.arange(len(symbols))
    while True:
        if size <= shortest < 2 * size:
            kept = np.isin(ends, ends[active])
            places, moved = np.flatnonzero(kept), np.cumsum(kept) - 1
            # texts stay whole and in order, so ranks close up by what left before them
            gap = (np.arange(len(kept)) - moved)[ends - 1]
            levels = [(x - gap)[kept] for x in levels]
            rank, active, ends = levels[-1], moved[active], moved[ends - 1][kept] + 1
        if not len(active):
            return levels, places
        on = active + size
        second = np.where(on < ends[active], rank[np.minimum(on, len(rank) - 1)] + 1, 0)
        rank, active = _split_groups(rank, active, second)
        levels.append(rank)
        size *= 2


class Agreement:
    """How far the words at two places agree."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = [np.append(x, -1) for x in levels]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words from a on and from b on, a < b, that are the same."""
        n, out, last = len(self.levels[0]) - 1, np.zeros(len(a), np.int64), len(self.levels) - 1
        for k in range(last, -1, -1):
            rank = self.levels[k]
            same = rank[np.minimum(a + out, n)] == rank[np.minimum(b + out, n)]
            out += same.astype(np.int64) << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words before a and before b, a < b, that are the same."""
        out, last = np.zeros(len(a), np.int64), len(self.levels) - 1
        for k in range(last, -1, -1):
            rank, step = self.levels[k], (1 << k)
            x, y = a - out - step, b - out - step
            same = (x >= 0) & (rank[np.maximum(x, 0)] == rank[np.maximum(y, 0)])
            out += same.astype(np.int64) << k
        return out


def _previous_factors(rank: np.ndarray, agree: Agreement) -> tuple[list[int], list[int]]:
    """The length of the longest stretch from each place on that begins earlier too, and where it does."""
    n = len(rank)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    near = np.stack([order[:-1], order[1:]])
    common = [0, *agree.forward(near.min(0), near.max(0)).tolist(), 0]
    before, after, at, suffix = list(range(-1, n)), list(range(1, n + 2)), rank.tolist(), order.tolist()
    length, source = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        r = at[i]
        left, right = before[r], after[r]
        a, b = common[r], common[right]
        if a >= b:
            length[i] = a
            source[i] = suffix[left] if a else 0
        else:
            length[i] = b
            source[i] = suffix[right]
            common[right] = a
        before[right] = left
        if left >= 0:
            after[left] = right
        if a < b:
            continue
        common[right] = b
    return length, source


def _touching(agree: Agreement, begin: np.ndarray, size: np.ndarray, first: np.ndarray, end: np.ndarray, least: int, times: int) -> dict[tuple[int, int], int]:
    """Runs (start, end) -> period that touch a boundary of blocks. Blocks: begin and size; first, end: those of their
    text."""
    inner = np.flatnonzero(begin > first)
    last = np.flatnonzero(begin + size == end)
    bound = np.concatenate([begin[inner], end[last]])
    both = np.concatenate([size[inner - 1] + size[inner], size[last]])
    low, high = (np.concatenate([x[inner], x[last]]) for x in (first, end))
    most = np.minimum((both - 1) // (times - 1), (high - low) // times)
    q = ranges(np.ones(len(most), np.int64), most)
    bound, low, high = (np.repeat(x, most) for x in (bound, low, high))
    found: dict[tuple[int, int], int] = {}
    for a, fits in ((bound - q, bound - q >= low), (bound, bound + q < high)):
        a, p = a[fits], q[fits]
        start, stop = a - agree.backward(a, a + p), a + p + agree.forward(a, a + p)
        run = stop - start >= np.maximum(least, times * p)
        for s, e, period in zip(start[run].tolist(), stop[run].tolist(), p[run].tolist(), strict=True):
            found[s, e] = min(period, found.get((s, e), period))
    return found


def _copied(found: dict[tuple[int, int], int], blocks: list[tuple[int, int, int]], least: int) -> list[Run]:
    """All runs in order of starts, those strictly inside blocks copied from the blocks' sources. blocks: begin, size and
    source."""
    bucket: dict[int, list[tuple[int, int]]] = {}
    for (s, e), q in found.items():
        bucket.setdefault(s, []).append((e, q))
    starts = sorted(bucket)
    for begin, size, source in blocks:
        if size < least + 2:
            continue
        at = bisect_right(starts, source)
        while at < len(starts) and starts[at] < source + size:
            s, on = starts[at], begin - source
            for e, q in list(bucket[s]):
                if e < source + size:
                    if s + on not in bucket:
                        insort(starts, s + on)
                    bucket.setdefault(s + on, []).append((e + on, q))
            at += 1
    return [(s, e, q) for s in starts for e, q in sorted(bucket[s], key=lambda r: r[1])]


def runs_of(texts: list[list[int]], least: int = 6, times: int = 4) -> list[list[Run]]:
    """The runs (start, end, period) of each text by start and period. A text is its words' numbers, from 0, each text
    with numbers of its own."""
    out: list[list[Run]] = [[] for _ in texts]
    size = np.array([len(t) for t in texts], np.int64)
    kinds = np.array([max(t, default=-1) + 1 for t in texts], np.int64)
    if not size.sum():
        return out
    symbols = np.concatenate([np.asarray(t, np.int64) for t in texts]) + np.repeat(np.cumsum(kinds) - kinds, size)
    text, end = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size)
    levels, places = _ranks(symbols, end, min(max(least, times * q) - q for q in range(1, least + 1)))
    if not len(places):
        return out
    text = text[places]
    edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
    agree = Agreement(levels)
    length, source = _previous_factors(levels[-1], agree)
    begins, p = [], 0
    while p < len(length):
        begins.append(p)
        p += length[p] or 1
    begin = np.array(begins)
    of = np.searchsorted(edges, begin, "right") - 1
    step = np.diff(begin, append=len(length))
    found = _touching(agree, begin, step, edges[of], edges[of + 1], least, times)
    blocks = [(b, n, source[b]) for b, n in zip(begins, step.tolist(), strict=True)]
    for s, e, q in _copied(found, blocks, least) if found else ():
        t = text[s]
        base = int(edges[np.searchsorted(edges, s, "right") - 1])
        out[t].append((s - base, e - base, q))
    return out


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that stand in a run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        edge[s + q] += 1
        edge[e] -= 1
    return [w for w, n in zip(words, np.cumsum(edge).tolist(), strict=False) if not n]


def _row(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else None
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    top = (None,) * 4 if best is None else (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2])
    return doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's rule: the words of every tenth document, by the crc32 of its id, become periodic from a place on."""
    h = 1 if doc_id is None else zlib.crc32(b"%d" % doc_id)
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    repeats = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * repeats)[: n - a]


def _search(least: int, times: int, alter: Callable[[int | None, list[bytes]], list[bytes]] | None) -> Callable:
    def answer(held: list[tuple]) -> pa.RecordBatch:
        found = runs_of([ids for *_, ids in held], least, times)
        rows = [_row(doc_id, words, runs) for (doc_id, words, _), runs in zip(held, found, strict=True)]
        columns = zip(*rows, strict=True)
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text = (batch.column(c)[i].as_py() for c in (0, 1))
                words = (text or b"").split()  # of bytes: at 0x20 and 0x09-0x0D only
                if alter is not None:
                    words = alter(doc_id, words)
                if held and n + len(words) > PIECE_WORDS:
                    yield answer(held)
                    held, n = [], 0
                numbers: dict[bytes, int] = {}
                held.append((doc_id, words, [numbers.setdefault(w, len(numbers)) for w in words]))
                n += len(words)
        if held:
            yield answer(held)

    return run


def find(docs: DataFrame, least: int = 6, times: int = 4, alter: Callable[[int | None, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and its exponent in thousandths, the digest of all
    runs and of the text without repeated periods, for each row of docs. alter: a function of id and words that gives the
    words to look at."""
    if times < 2 or least < 2:
        raise ValueError("a run has two periods or more")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_search(least, times, alter), _SCHEMA)
