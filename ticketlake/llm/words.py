"""Words of whole Arrow batches and their 64-bit hashes, without a Python loop per text.

Memory is bounded by slices: a batch is worked through in pieces of about
``SLICE`` bytes that end between words, so very long texts need no more room per
byte than short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def letters(lower: bool) -> np.ndarray:
    return _BYTE[_LOWER] if lower else _BYTE


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: separators of `[^\x20\x09-\x0D]+` and of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (the latter on lower-cased text)
SPACES = _table((0x20, 0x20), (0x09, 0x0D))
PUNCTUATION = _table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """odd**i and odd**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, SLICE + (1 << 16))
        _powers[:] = [_geometric(_ODD, n), _geometric(pow(_ODD, -1, 1 << 64), n)]
    return _powers[0], _powers[1]


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    have = 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U64(pow(base, have, 1 << 64))
        have += more
    return out


@dataclass
class Words:
    """Words of texts 0..n-1, text by text.

    ``first[i]:first[i + 1]`` are the words of text i; ``start`` and ``end`` are
    byte offsets into ``data``.
    """

    data: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text each word is from."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def _cut(data, separators, bounds, start: int, stop: int) -> int:
    """Where the slice from ``start`` ends: between words, soon after SLICE bytes."""
    end = start + SLICE
    if end >= stop:
        return stop
    limit = int(bounds[np.searchsorted(bounds, end)])  # the next text's start
    while end < limit:
        found = np.flatnonzero(separators[data[end : min(limit, end + 4096)]])
        if len(found):
            return end + int(found[0])
        end += 4096
    return limit


def split(texts: pa.Array, separators: np.ndarray = SPACES, lower: bool = False) -> Words:
    data, bounds = buffers(texts)
    bytes_ = letters(lower)
    starts, ends, hashes = [], [], []
    at, stop = int(bounds[0]), int(bounds[-1])
    while at < stop:
        end = _cut(data, separators, bounds, at, stop)
        piece = data[at:end]
        n = len(piece)
        word = ~separators[piece]
        begins = np.empty(n, bool)
        begins[0] = True
        np.logical_not(word[:-1], out=begins[1:])
        ends_here = np.empty(n, bool)
        ends_here[-1] = True
        np.logical_not(word[1:], out=ends_here[:-1])
        lo, hi = np.searchsorted(bounds, [at, end])
        edges = bounds[lo:hi] - at
        edges = edges[(edges > 0) & (edges < n)]
        begins[edges] = True
        ends_here[edges - 1] = True
        s = np.flatnonzero(begins & word)
        e = np.flatnonzero(ends_here & word) + 1
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum(bytes_[piece] * up[:n], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        hashes.append(mix(h + (e - s).astype(U64)))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(
        data, np.searchsorted(start, bounds), start, join(ends, np.int64), join(hashes, U64)
    )


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of ``width`` consecutive values from each place on; too near the end: dropped."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(width))
    for j in range(width):
        out *= U64(_ODD)
        out += hashes[j : j + n]
    return mix(out)


def inside(words: Words, width: int) -> np.ndarray:
    """For each of ``grams(words.hash, width)``: whether it lies within one text."""
    n = len(words.hash) - width + 1
    ok = np.ones(max(n, 0), bool)
    for j in range(1, width):  # a start that is less than width before a text's end
        at = words.first[1:-1] - j
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok


def whole(words: Words) -> np.ndarray:
    """One hash per text over all its words (0 words: a fixed value)."""
    return spans(words.hash, words.first[:-1], words.first[1:])


def spans(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash for each run ``hashes[start:end]``; the order of the values counts."""
    out = np.zeros(len(start), U64)
    if not len(hashes) or not len(start):
        return mix(out)
    # prefix sums of value * odd**place, in pieces so that the powers stay short
    up, down = _power_tables(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    out = (total[end] - total[start]) * down[start]
    return mix(out + mix((end - start).astype(U64)))


def batches(rows: pa.RecordBatch, column: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """``rows`` in pieces whose texts hold about ``limit`` bytes (one row at least)."""
    _, bounds = buffers(rows.column(column))
    at, n = 0, rows.num_rows
    while at < n:
        to = int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield rows.slice(at, to - at)
        at = to
