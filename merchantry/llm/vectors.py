"""Words, shingles and their 64-bit hashes of many texts at once, with numpy on Arrow buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D, the same as [^\\x20\\x09-\\x0D]+ on code points. Texts are worked
on in pieces of about a megabyte, so that memory does not follow the batch; a longer text is a piece of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
SHORT_BYTES = 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_BASE = pow(0x9E3779B97F4A7C15, 3, 1 << 64) | 1
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_SEED, _ALL = np.uint64(0xA0761D6478BD642F), np.uint64(0xFFFFFFFFFFFFFFFF)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Piece(NamedTuple):
    """Some rows of a batch: row numbers first..first+n-1, their bytes, n + 1 offsets into the bytes."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of a piece: byte ranges, the number of their text within the piece, hashes, and words a text."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


def pieces(texts: pa.Array) -> Iterator[Piece]:
    """The texts of an Arrow string column in pieces; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
        last = min(max(last, first + 1), n)
        yield Piece(first, last - first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * PIECE_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial sums, from which range_hashes() has the hash of any short byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges of less than 1024 bytes, any of which may be asked for; equal bytes have equal hashes wherever
    they stand. From 1024 bytes on there are texts of two letters that collide by construction: see hashes()."""
    inverse = _powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _FOLD)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 16) -> np.ndarray:
    """BLAKE2b digests of byte ranges, a row of size / 8 numbers each. Of 16 bytes, they stand for the bytes."""
    held = data.tobytes()
    out = b"".join([hashlib.blake2b(held[a:b], digest_size=size).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(out, np.uint64).reshape(len(starts), size // 8)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges. Ranges up to SHORT_BYTES are mixed eight bytes at a time, each step a bijection of the
    state so far; longer ones have the first eight bytes of a BLAKE2b digest."""
    size = (ends - starts).astype(np.uint64)
    out = mix(size * _FOLD + _SEED)
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), np.uint64, held, strides=(1,))  # the eight bytes from each place on
    left = np.flatnonzero((size > 0) & (size <= SHORT_BYTES))
    for k in range(0, SHORT_BYTES, 8):
        rest = np.minimum(size[left] - np.uint64(k), np.uint64(8))
        value = eights[starts[left] + k] & (_ALL >> (np.uint64(64) - np.uint64(8) * rest))
        out[left] = mix((out[left] ^ value) * _FOLD + _SEED)
        left = left[size[left] > k + 8]
        if not len(left):
            break
    long = np.flatnonzero(size > SHORT_BYTES)
    if len(long):
        out[long] = digests(data, starts[long], ends[long], 8)[:, 0]
    return out


def edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, cut where a text begins."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty(len(inside), bool)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(inside), bool)
    after[-1], after[:-1] = False, inside[1:]
    after[cuts - 1] = False
    return starts, np.flatnonzero(inside & ~after) + 1


def words(piece: Piece, lower: bool = False) -> Words:
    data = (_LOWER if lower else _SAME)[piece.data] if lower else piece.data
    starts, ends = edges(~_SPACE[data], piece.offsets)
    text = np.searchsorted(piece.offsets, starts, "right") - 1
    return Words(starts, ends, text, hashes(data, starts, ends), np.bincount(text, minlength=piece.n))


def windows(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each window of k words within one text."""
    n = len(found.text) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(found.text[:n] == found.text[k - 1 :])
    out = found.hashes[first].copy()
    for j in range(1, k):
        out = out * _FOLD + found.hashes[first + j]
    return first, mix(out)


def shingle_sets(found: Words, k: int = 5) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted int64 hashes; a text of 1 to k-1 words has itself as the only one."""
    first, hashes = windows(found, k)
    signed = hashes.view(np.int64)
    ends = np.cumsum(np.bincount(found.text[first], minlength=len(found.counts)))
    word_ends = np.cumsum(found.counts)
    out, begin = [], 0
    for t, end in enumerate(ends):
        if end > begin:
            out.append(np.unique(signed[begin:end]))
        elif found.counts[t]:
            own = found.hashes[word_ends[t] - found.counts[t] : word_ends[t]]
            value = np.full(1, len(own), np.uint64)
            for h in own:
                value = mix(value * _FOLD + h)
            out.append(value.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
        begin = end
    return out


def lists(values: list[np.ndarray]) -> pa.Array:
    """An Arrow column of int64 lists."""
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
