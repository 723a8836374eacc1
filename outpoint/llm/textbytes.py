"""Words, shingles and lines of many texts at once, as 64-bit hashes from numpy.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D`` after
``A-Z`` are lower-cased. Its hash is a sum of random numbers per byte value
times powers of an odd number, taken from running sums over a block of text,
so there is no loop over words. Texts over a block are worked through in
blocks that end at white space.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
WIDTH = 5  # words of a shingle

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_random = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
STEPS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(33))  # a new array, changed in place from here on
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the odd number and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK + 4096)
        up = np.full(size, _ODD, np.uint64)
        up[0] = 1
        down = np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buffer[at[0] : at[-1]], at - at[0]


def runs(at: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``block`` bytes each; a longer row is alone."""
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + block, "right")) - 1)
        yield first, last
        first = last


def _spans(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; words also end at ``breaks``."""
    word = ~_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    begin[inner] = word[inner]
    stop[inner - 1] = word[inner - 1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of ``data`` with A-Z lower-cased."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _long_words(data: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, block by block."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not _SPACE[data[end - 1]]:
            stop = np.flatnonzero(_SPACE[data[end : end + BLOCK]])
            end = end + int(stop[0]) + 1 if len(stop) else min(len(data), end + BLOCK)
        part = data[at:end]
        out.append(span_hashes(part, *_spans(part, np.zeros(0, np.int64))))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def word_hashes(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, words per row, hashes of the words in order) for runs of rows."""
    data, at = string_parts(column)
    for first, last in runs(at):
        part = data[at[first] : at[last]]
        if len(part) > BLOCK and last == first + 1:
            words = _long_words(part)
            yield first, np.array([len(words)]), words
            continue
        edges = at[first : last + 1] - at[first]
        begin, end = _spans(part, edges)
        counts = np.diff(np.searchsorted(begin, edges))
        yield first, counts, span_hashes(part, begin, end) if len(begin) else np.zeros(0, np.uint64)


def shingles(counts: np.ndarray, words: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle; fewer words than ``width`` make one shingle."""
    ends = np.cumsum(counts)
    starts = ends - counts
    row_of = np.repeat(np.arange(len(counts)), counts)
    room = ends[row_of] - np.arange(len(words))  # words from here to the end of the row
    whole = room >= width
    at = np.flatnonzero(whole)
    every = np.zeros(len(words), np.uint64)
    for k in range(min(width, len(words))):
        every[: len(words) - k] += words[k:] * STEPS[k]
    rows, hashes = row_of[at], mixed(every[at])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        part = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            part[has] += words[starts[short[has]] + k] * STEPS[k]
        part = mixed(part + counts[short].astype(np.uint64) * STEPS[63])
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, part])
    return rows, hashes


def sort_segments(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A copy of ``values`` with the values of each run of equal ``groups`` in order.

    Many short sorts are much faster than one sort by two keys.
    """
    values = values.copy()
    cuts = np.flatnonzero(groups[1:] != groups[:-1]) + 1
    for lo, hi in pairwise([0, *cuts.tolist(), len(values)]):
        values[lo:hi].sort()
    return values


def distinct_sorted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, hash) pairs in order."""
    if (rows[1:] < rows[:-1]).any():
        order = np.argsort(rows, kind="stable")
        rows, hashes = rows[order], hashes[order]
    hashes = sort_segments(rows, hashes)
    if len(rows):
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
        rows, hashes = rows[new], hashes[new]
    return rows, hashes


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, sorted distinct shingle hashes) for runs of rows."""
    for first, counts, words in word_hashes(column):
        rows, hashes = distinct_sorted(*shingles(counts, words))
        yield first, np.searchsorted(rows, np.arange(len(counts) + 1)), hashes
