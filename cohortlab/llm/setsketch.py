"""SetSketch registers of hashed sets, in numpy.

A register is 1 - floor(log_B(h)) of the least of exponentially distributed values that the
elements draw, truncated to one byte.  Sketches of a union are the element-wise maximum, equal
registers grow with the similarity, and the counts of larger, smaller and equal registers give
the joint estimate.
"""

from __future__ import annotations

import numpy as np

from cohortlab.llm.textscan import mix

BASE = 2 ** (1 / 8)
RATE = 4.0
BAND = 6  # registers in a band
BANDS = 60
REGISTERS = BAND * BANDS
LIMIT = 255

_seeds = mix(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64))
_FACTOR = (_seeds[:REGISTERS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFT = (_seeds[REGISTERS:] >> np.uint64(32)).astype(np.uint32)
_EMPTY = np.zeros(REGISTERS, dtype=np.uint8)
_WIDTH = 2048


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a set of 64-bit hashes."""
    if not len(elements):
        return _EMPTY
    short = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), _WIDTH):
            drawn = _FACTOR[:, None] * short[None, at : at + _WIDTH]
            drawn += _SHIFT[:, None]
            np.minimum(least, drawn.min(axis=1), out=least)
    exponential = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One 64-bit key a band for each row of registers."""
    bands = registers.reshape(-1, BANDS, BAND).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2]).copy()
    for j in range(BAND):
        keys = (keys << np.uint64(8)) | bands[:, :, j]
    return mix(keys).view(np.int64)


def _larger(x: np.ndarray) -> np.ndarray:
    """Chance that a register of one set exceeds the other's, from the share that only it has."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, m: int) -> np.ndarray:
    """Likeliest Jaccard similarity of pairs, from how many of m registers of a lie above and below those of b."""
    u = size_a / (size_a + size_b)
    v = 1 - u
    equal = m - above - below
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more = np.maximum(_larger(np.maximum(u - v * j, 0)), 1e-12)
        less = np.maximum(_larger(np.maximum(v - u * j, 0)), 1e-12)
        return above * np.log(more) + below * np.log(less) + equal * np.log(np.maximum(1 - more - less, 1e-12))

    for _ in range(24):  # the likelihood has one maximum
        a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        right = likelihood(a) < likelihood(b)
        lo, hi = np.where(right, a, lo), np.where(right, hi, b)
    return (lo + hi) / 2
