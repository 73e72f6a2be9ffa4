"""Words and word shingles of whole texts as numpy arrays, for use inside Spark tasks.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text.
Words are 64-bit hashes that depend on the word alone, so texts may be cut at any
white space; the arrays that a cut needs stay a few megabytes for texts of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 18  # bytes hashed at once
SHINGLE = 5

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_PLACE = mix(np.arange(101, 101 + SHINGLE, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, BLOCK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of at most about BLOCK bytes that end at a row's end or at white space."""
    at, end, cuts = int(offsets[0]), int(offsets[-1]), []
    while at < end:
        to = at + BLOCK
        if to >= end:
            to = end
        else:
            row_end = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            if row_end > at:
                to = row_end
            else:
                while to < end and not _SPACE[data[to]]:
                    gap = np.flatnonzero(_SPACE[data[to : to + BLOCK]])
                    to = to + int(gap[0]) if len(gap) else min(to + BLOCK, end)
                    if to >= (nxt := int(offsets[np.searchsorted(offsets, at, "right")])):
                        to = nxt
                        break
        cuts.append((at, to))
        at = to
    return cuts


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 offsets of the rows among them."""
    hashes, starts = [], []
    row_starts = np.unique(offsets[:-1]) if len(offsets) > 1 else np.zeros(0, np.int64)
    for lo, hi in _cuts(data, offsets):
        block = data[lo:hi]
        if lower:
            block = _LOWER[block]
        inside = ~_SPACE[block]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        near = row_starts[np.searchsorted(row_starts, lo) : np.searchsorted(row_starts, hi)] - lo
        first[near] = inside[near]
        begin = np.flatnonzero(first)
        if not len(begin):
            continue
        last = inside
        last[:-1] &= ~inside[1:] | first[1:]
        stop = np.flatnonzero(last)
        up, down = _power_table(len(block))
        with np.errstate(over="ignore"):
            values = _BYTE[block] * up[: len(block)]
            sums = np.cumsum(values, dtype=np.uint64)
            hashes.append(mix((sums[stop] - sums[begin] + values[begin]) * down[begin]))
        starts.append(begin + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles of one text.

    Fewer words make one shingle of them all; no words make none.
    """
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            return mix((words * _PLACE[:n]).sum(dtype=np.uint64) + _U(n))[None]
        total = words[: n - SHINGLE + 1] * _PLACE[0]
        for j in range(1, SHINGLE):
            total += words[j : n - SHINGLE + 1 + j] * _PLACE[j]
    total = mix(total)
    total.sort()
    new = np.empty(len(total), dtype=bool)
    new[0] = True
    np.not_equal(total[1:], total[:-1], out=new[1:])
    return total[new]
