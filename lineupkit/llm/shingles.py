"""Sets of word shingles as 64-bit hashes, computed for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C13  # odd, so it has an inverse modulo 2**64
_STEP = 1 << 20

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_LETTER = np.random.default_rng(20_241).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z count as a-z
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _STEP + (1 << 16))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[k : k + 1] = [np.cumprod(steps, dtype=np.uint64)]
    return _powers


def _word_hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word; ``breaks`` are places where a new text begins."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    black = ~_BLANK[data]
    new = np.zeros(n + 1, bool)
    new[breaks] = True
    new[[0, n]] = True
    before = np.concatenate([[False], black])
    after = np.concatenate([black, [False]])
    first = np.flatnonzero(after & (~before | new))
    stop = np.flatnonzero(before & (~after | new))
    up, down = _power_tables(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up[:n], dtype=np.uint64)])
    return mix64((total[stop] - total[first]) * down[first]), first


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts laid end to end and the number of words of each, in bounded pieces."""
    hashes, places = [], []
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(end, lo + _STEP)
        while hi < end and not _BLANK[data[hi]]:  # never cut a word
            stretch = np.flatnonzero(_BLANK[data[hi : min(end, hi + 4096)]])
            hi = hi + int(stretch[0]) if len(stretch) else min(end, hi + 4096)
        inside = offsets[(offsets > lo) & (offsets < hi)] - lo
        found, first = _word_hashes(data[lo:hi], inside)
        hashes.append(found)
        places.append(first + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    edges = np.searchsorted(np.concatenate(places), offsets)
    return np.concatenate(hashes), np.diff(edges)


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingles of ``n`` words for each text; fewer words are one shingle."""
    odd = np.uint64(0xD6E8FEB86659FD93)
    joined = hashes.copy()
    for k in range(1, min(n, len(joined))):  # all texts together may have fewer words than a shingle
        joined[: len(joined) - k] = joined[: len(joined) - k] * odd + hashes[k:]
    joined = mix64(joined)
    out, at = [], 0
    for m in counts.tolist():
        if m >= n:
            own = np.sort(joined[at : at + m - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif m:
            value = m
            for h in hashes[at : at + m].tolist():
                value = (value * int(odd) + h) & _MASK
            out.append(mix64(np.array([value], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def batch_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Shingle sets of an Arrow column of texts (null: empty), a few MB of text at a time."""
    for first in range(0, len(texts), 512):
        yield from _some_sets(texts.slice(first, 512).fill_null("").cast(pa.large_string()), n)


def _some_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _STEP, "right")) - 1)
        yield from shingle_sets(*words_of(data, offsets[at : to + 1]), n)
        at = to


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit identity of a set, as a signed integer."""
    with np.errstate(over="ignore"):
        value = mix64(np.array([mix64(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64))
    return int(value.view(np.int64)[0])
