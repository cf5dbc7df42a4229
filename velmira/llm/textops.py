"""Vectorised text primitives shared by the llm operators (numpy over whole Arrow batches).

*Words* are the unbroken runs of ``a``-``z`` and ``0``-``9`` of the lower-cased text.  A batch of texts
becomes one flat ``uint64`` array of word hashes with offsets, so that every later step (rolling hashes,
minima, shingles) is a handful of array operations for thousands of texts at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

WORD = re.compile(r"[a-z0-9]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_IS_WORD = np.zeros(256, bool)
_IS_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
_SLICE = 1 << 18  # bytes hashed at a time, so that the arrays stay in the cache
_BASE = 0xD1B54A32D192ED03
_UP, _DOWN = _powers(_BASE, 2 * _SLICE), _powers(pow(_BASE, -1, 1 << 64), 2 * _SLICE)


def word_hashes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(flat uint64 hashes, int64 offsets of length n+1). Null and empty texts have no words.

    A word's hash is its polynomial in the bytes: differences of one running sum, so no word becomes a Python object.
    Equal on every executor and every run.
    """
    raw = [text.lower().encode("utf-8", "replace") if text else b"" for text in texts]
    ends_of_rows = np.cumsum([len(r) + 1 for r in raw])
    blob = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if len(blob) == 0:
        return np.empty(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
    inside = _IS_WORD[blob]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[::2], edges[1::2]  # every row ends in a separator, so every word does
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(int(np.searchsorted(ends, starts[at] + _SLICE)), at + 1)
        low, high = int(starts[at]), int(ends[end - 1])
        up, down = (_UP, _DOWN) if high - low < len(_UP) else (_powers(_BASE, high - low + 1), _powers(pow(_BASE, -1, 1 << 64), high - low + 1))
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(blob[low:high] * up[: high - low], out=total[1:])
        s, e = starts[at:end] - low, ends[at:end] - low
        out[at:end] = (total[e] - total[s]) * down[s]
        at = end
    return mix(out), np.concatenate(([0], np.searchsorted(starts, ends_of_rows))).astype(np.int64)


def grams(words: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of every k consecutive words inside a text: (flat hashes, offsets)."""
    counts = np.maximum(np.diff(offsets) - (k - 1), 0)
    out_offsets = np.concatenate(([0], np.cumsum(counts)))
    if len(words) < k:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    n = len(words) - k + 1
    rolled = words[:n].copy()
    for j in range(1, k):
        rolled *= _P
        rolled += words[j : j + n]
    rolled = mix(rolled)
    start = np.repeat(offsets[:-1] - out_offsets[:-1], counts) + np.arange(out_offsets[-1])
    return rolled[start], out_offsets


def row_index(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def minima(hashes: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Positions that hold the least hash of some ``window`` consecutive positions of their text.

    A text with fewer positions than the window counts as one window.  Which positions are taken depends
    on nothing outside the window, so equal stretches of different texts are cut alike.
    """
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64)
    if window <= 1:
        return np.arange(n)
    row = row_index(offsets)
    ends = offsets[1:][row]
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = hashes.copy()
    for j in range(1, min(window, n)):
        ahead = np.full(n, top)
        ahead[: n - j] = hashes[j:]
        ahead[np.arange(n) + j >= ends] = top
        np.minimum(low, ahead, out=low)
    starts = offsets[:-1][row]
    at = np.arange(n)
    opens = (at + window <= ends) | (at == starts)
    taken = opens & (low == hashes)
    for j in range(1, min(window, n)):
        same = opens[: n - j] & (low[: n - j] == hashes[j:]) & (at[j:] < ends[: n - j])
        taken[j:] |= same
    return np.flatnonzero(taken)


def distinct_sorted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text: (flat, offsets)."""
    if len(values) == 0:
        return values, np.zeros(len(offsets), np.int64)
    row = row_index(offsets)
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    counts = np.bincount(r[keep], minlength=len(offsets) - 1)
    return v[keep], np.concatenate(([0], np.cumsum(counts)))


def set_digest(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Order-free 64-bit digest of each text's distinct values."""
    scrambled = mix(values ^ np.uint64(0xD6E8FEB86659FD93))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled)))
    return mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
