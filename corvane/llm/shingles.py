"""Hashed word shingles of whole texts, with numpy over the bytes of many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CODES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers = both[0], both[1]
    return _powers


def word_hashes(data: np.ndarray, ends_at: np.ndarray, blank: np.ndarray = _BLANK, front: int = 0) -> tuple[np.ndarray, ...]:
    """The hash of each word of data (bytes; A-Z lower-cased, words between bytes that are blank, by default ASCII
    white space), and where it starts; with front, also the hash of its first `front` bytes, 0 for shorter words. No
    word goes across the positions in ends_at (ascending). Works in blocks, so memory stays small for long texts."""
    hashes, starts, fronts = [], [], []
    n, at = len(data), 0
    while at < n:
        end = min(n, at + _BLOCK)
        while end < n and not blank[data[end - 1]]:  # a block ends with a blank
            more = np.flatnonzero(blank[data[end : end + _BLOCK]])
            end = end + int(more[0]) + 1 if more.size else min(n, end + _BLOCK)
        part = data[at:end]
        inner = ends_at[np.searchsorted(ends_at, at) : np.searchsorted(ends_at, end)] - at
        full = ~blank[part]
        before = np.empty_like(full)
        before[0] = False
        before[1:] = full[:-1]
        before[inner[inner < len(part)]] = False
        first = np.flatnonzero(full & ~before)
        after = np.empty_like(full)
        after[-1] = False
        after[:-1] = full[1:]
        after[inner[inner > 0] - 1] = False
        last = np.flatnonzero(full & ~after) + 1
        up, down = _powers_upto(len(part) + 1)
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_CODES[_LOWER[part]] * up[: len(part)], out=sums[1:])
        hashes.append(mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        starts.append(first + at)
        if front:
            upto = np.minimum(first + front, last)
            fronts.append(np.where(last - first >= front, mixed((sums[upto] - sums[first]) * down[first]), _U(0)))
        at = end
    empty = [np.empty(0, np.uint64)]
    out = np.concatenate(hashes or empty), np.concatenate(starts or [np.empty(0, np.int64)])
    return (*out, np.concatenate(fronts or empty)) if front else out


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of k words; of fewer words, one hash of all of them; of
    none, nothing. Hashes have 64 bits: two of m different shingles share one with a chance of m * m / 2 ** 65."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    words, starts = word_hashes(data, ends)
    bounds = np.searchsorted(starts, ends)
    factors = mixed(np.arange(1, k + 1, dtype=np.uint64)) | _U(1)
    m = max(0, len(words) - k + 1)
    runs = np.zeros(m, dtype=np.uint64)
    for i in range(k):
        runs += words[i : i + m] * factors[i]
    runs = mixed(runs)
    lo = 0
    for hi in bounds.tolist():
        if hi - lo >= k:
            yield np.unique(runs[lo : hi - k + 1])
        elif hi > lo:
            own = words[lo:hi] * factors[: hi - lo]
            yield mixed(np.array([np.bitwise_xor.reduce(own) + _U(hi - lo)], dtype=np.uint64))
        else:
            yield np.empty(0, np.uint64)
        lo = hi
