"""A dictionary of phrases as sorted arrays, which is sent to the tasks: titles are then searched where they are, and nothing is shuffled.

A phrase is a path of words. Nodes of the first level are the words' numbers; a node of a later level is the place of (node above, word) in
the sorted array of its level. All places of a batch of titles are walked at once, a level at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from merchantry.operators.vectors import pieces

#: Windows whose answers a task keeps.
KEPT_WINDOWS = 200_000


class Trie(NamedTuple):
    """words: of all phrases. levels: for each level but the first its sorted keys. phrase: by level and node the phrase that ends there, or -1."""

    words: pa.Array
    levels: list[np.ndarray]
    phrase: list[np.ndarray]


def trie(phrases: pa.Array) -> Trie:
    """Of lists of words, each of which is one phrase and stands once."""
    size = pc.list_value_length(phrases).to_numpy(zero_copy_only=False)
    coded = phrases.flatten().dictionary_encode()
    codes, begin = coded.indices.to_numpy().astype(np.int64), np.cumsum(size) - size
    levels, ends = [], []
    node, on = codes[begin] if len(begin) else codes, np.arange(len(size))
    count = len(coded.dictionary)
    for d in range(1, int(size.max(initial=0)) + 1):
        end = np.full(count, -1, np.int64)
        last = size[on] == d
        end[node[last]] = on[last]
        ends.append(end)
        node, on = node[~last], on[~last]
        if len(on):
            keys, node = np.unique(node << 32 | codes[begin[on] + d], return_inverse=True)
            levels.append(keys)
            count = len(keys)
    return Trie(coded.dictionary, levels, ends)


class _Titles:
    """A piece of titles: flat numbers of words (-1 for others), where each title begins, and the hits at each place."""

    def __init__(self, known: Trie, lists: pa.Array) -> None:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        number = pc.fill_null(pc.index_in(coded.dictionary, known.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids = number[coded.indices.to_numpy()] if len(number) else np.zeros(0, np.int64)
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        stop = self.ends[self.row] if len(self.row) else self.row
        found = []
        at = np.flatnonzero(self.ids >= 0)
        node = self.ids[at]
        for d, end in enumerate(known.phrase, 1):
            hit = end[node] >= 0
            found.append((at[hit], np.full(hit.sum(), d), end[node[hit]]))
            if d == len(known.phrase):
                break
            inside = at + d < stop[at]
            at, node = at[inside], node[inside]
            at, node = _below(known.levels[d - 1], at, node, self.ids[at + d])
        parts = list(zip(*found, strict=True)) if found else [[np.zeros(0, np.int64)]] * 3
        self.at, self.n, self.phrase = (np.concatenate(p) for p in parts)
        order = np.lexsort((self.n, self.at))
        self.at, self.n, self.phrase = self.at[order], self.n[order], self.phrase[order]

    def longest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        last = np.append(self.at[1:] != self.at[:-1], True) if len(self.at) else np.zeros(0, bool)
        return self.at[last], self.n[last], self.phrase[last]


def _below(keys: np.ndarray, at: np.ndarray, node: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = node << 32 | np.maximum(word, 0)
    place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    on = (word >= 0) & (keys[place] == key)
    return at[on], place[on]


def _lists(begins: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(begins, len(values)).astype(np.int32)), values)


def _titles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of batches whose second column are the words that are looked up."""
    for batch in batches:
        if not pa.types.is_null(batch.column(1).type):
            yield from pieces(batch)


def names_found(sent, key: str) -> Callable:
    """key and found. sent: a broadcast of (trie, begins, ranks, names): the names of phrase p are at ranks[begins[p]:begins[p + 1]] of names,
    which are in the order in which they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, begins, ranks, names = sent.value
        for piece in _titles(batches):
            titles = _Titles(known, piece.column(1))
            end, taken = 0, []
            at, n, phrase = titles.longest()
            for i, (a, m) in enumerate(zip(at.tolist(), n.tolist(), strict=True)):
                if a >= end:
                    taken.append(i)
                    end = a + m
            row, phrase = titles.row[at[taken]], phrase[taken]
            times = begins[phrase + 1] - begins[phrase]
            place = np.arange(times.sum()) + np.repeat(begins[phrase] - np.cumsum(times) + times, times)
            row, rank = np.divmod(np.unique(np.repeat(row, times) * len(names) + ranks[place]), max(len(names), 1))
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row[first])), _lists(first, names.take(pa.array(rank)))], names=[key, "found"])

    return run


def places_left(sent, names: list[str]) -> Callable:
    """The columns of a batch but the second, and kept: the places that deletions leave, or null where nothing is deleted. Places that stand
    together as written have their hits from one walk; what a deletion brings together is looked up as it comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        longest, answers = len(known.phrase), {}

        def looked_up(window: tuple[int, ...]) -> int:
            n = answers.get(window)
            if n is None:
                n, node = 0, window[0]
                for d, end in enumerate(known.phrase, 1):
                    if end[node] >= 0:
                        n = d
                    if d == len(window) or d == longest or window[d] < 0:
                        break
                    keys, key = known.levels[d - 1], node << 32 | window[d]
                    node = int(np.searchsorted(keys, key))
                    if node == len(keys) or keys[node] != key:
                        break
                if len(answers) >= KEPT_WINDOWS:
                    answers.clear()
                answers[window] = n
            return n

        def left_of(ids: list[int], hit: list[int]) -> list[int]:
            left, right = [], list(range(len(ids) - 1, -1, -1))
            while right:
                first, size = right[-1], min(longest, len(right))
                if right[-size] - first < size:
                    n = hit[first]
                else:
                    n = looked_up(tuple([ids[i] for i in right[: -size - 1 : -1]])) if ids[first] >= 0 else 0
                if n:
                    del right[-n:]
                    back = min(longest - 1, len(left))
                    if back:
                        right += left[: -back - 1 : -1]
                        del left[-back:]
                else:
                    left.append(right.pop())
            return left

        for piece in _titles(batches):
            titles = _Titles(known, piece.column(1))
            hit = np.zeros(len(titles.ids), np.int64)
            at, n, _ = titles.longest()
            hit[at] = n
            kept: list[list[int] | None] = [None] * len(piece)
            for r in np.unique(titles.row[at]).tolist():
                a, b = titles.begins[r], titles.ends[r]
                kept[r] = left_of(titles.ids[a:b].tolist(), hit[a:b].tolist())
            columns = [piece.column(0), *piece.columns[2:], pa.array(kept, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "kept"])

    return run


def segments_begun(sent, names: list[str]) -> Callable:
    """The columns of a batch but the second, and begins: the places where the segments of the most probable split begin. sent: a broadcast of
    (trie, the weight of each phrase, the weight of a token that is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, plain = sent.value
        for piece in _titles(batches):
            titles = _Titles(known, piece.column(1))
            begins = np.ones(len(titles.ids), bool)
            at, n, w = titles.at, titles.n, weights[titles.phrase]
            reach = np.maximum.accumulate(at + n)
            new = np.append(True, at[1:] >= reach[:-1]) if len(at) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)).astype(np.int64)
            several = np.maximum.reduceat(n, first) > 1 if len(first) else new
            inner = []
            for a, b in zip(first[several].tolist(), last[several].tolist(), strict=True):
                start, size = int(at[a]), int(reach[b - 1] - at[a])
                edges: list[list[tuple[int, float]]] = [[] for _ in range(size)]
                for x, m, v in zip((at[a:b] - start).tolist(), n[a:b].tolist(), w[a:b].tolist(), strict=True):
                    edges[x].append((m, v))
                best, back = [0.0] + [-np.inf] * size, [0] * (size + 1)
                for x, out in enumerate(edges):
                    if not out or out[0][0] != 1:
                        out.insert(0, (1, plain))
                    for m, v in out:
                        if best[x] + v > best[x + m]:
                            best[x + m], back[x + m] = best[x] + v, x
                x = size
                while x:
                    inner += range(start + back[x] + 1, start + x)
                    x = back[x]
            begins[inner] = False
            place = np.flatnonzero(begins)
            of = _lists(np.searchsorted(place, titles.begins), pa.array((place - titles.begins[titles.row[place]]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([piece.column(0), *piece.columns[2:], of], names=[*names, "begins"])

    return run
