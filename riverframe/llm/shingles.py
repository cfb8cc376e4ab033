"""Word shingles of many texts at once, hashed to 64 bits with numpy inside Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# A polynomial hash for windows of a few dozen bytes. It is not for words: some of a thousand bytes and more collide in it whatever the base.
_RNG = np.random.default_rng(20240611)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd numbers that tell blocks, lengths and places apart.
_BLOCK, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text) of texts that lie end to end in `data`.

    A word's blocks of eight bytes are each mixed with their place, summed up, and mixed with the length: no word
    differs from another by terms that cancel, as they do in a polynomial of the bytes."""
    data = _FOLD[data]
    blank = _SPACE[data]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds) - 1, np.int64)
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = blank[:-1]
    before[bounds[:-1][bounds[:-1] < n]] = True
    starts = np.flatnonzero(before & ~blank)
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = blank[1:]
    inner = bounds[1:]
    after[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(after & ~blank) + 1
    hashes = np.zeros(0, np.uint64)
    if len(starts):
        sizes = ends - starts
        blocks = (sizes + 7) // 8
        first = np.cumsum(blocks) - blocks
        place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        left = np.repeat(sizes, blocks) - 8 * place
        # Eight bytes from any byte on, of which those beyond the word are cleared.
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        eight = np.ndarray((n,), "<u8", padded, strides=(1,))[np.repeat(starts, blocks) + 8 * place]
        eight &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(8) * np.maximum(0, 8 - left).astype(np.uint64))
        mixed = mix(eight + mix((place.astype(np.uint64) + np.uint64(1)) * _BLOCK))
        hashes = mix(np.add.reduceat(mixed, first) + sizes.astype(np.uint64) * _LENGTH)
    at = np.searchsorted(starts, bounds)
    return hashes, np.diff(at)


def shingle_sets(texts: pa.Array, k: int, limit: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For parts of a batch of about `limit` bytes: (distinct shingles text after text, each text's sorted; their numbers).

    A text with fewer than k words has its whole sequence as one shingle; without words it has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    total = len(texts)
    _, offsets, values = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, total + 1) if offsets is not None else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    first = 0
    while first < total:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        part = bounds[first : last + 1]
        hashes, counts = word_hashes(data[part[0] : part[-1]], part - part[0])
        ends = np.cumsum(counts)
        rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for j in range(k):
            rolled = mix(rolled + hashes[j : j + len(rolled)] * np.uint64(2 * j + 1) + np.uint64(k))
        sets = []
        for end, count in zip(ends, counts):
            start = end - count
            if count >= k:
                s = np.sort(rolled[start : end - k + 1])
                sets.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif count:
                acc = np.zeros(1, np.uint64)
                for h in hashes[start:end]:
                    acc = mix(acc + h)
                sets.append(mix(acc + np.uint64(count)))
            else:
                sets.append(np.zeros(0, np.uint64))
        sizes = np.array([len(s) for s in sets], np.int64)
        yield np.concatenate(sets), sizes
        first = last


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum modulo 2^64 of each run of values."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]
