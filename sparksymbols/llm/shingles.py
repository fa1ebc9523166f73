"""Word shingles of whole texts as 64-bit hashes, computed on arrays of bytes inside tasks.

Words are runs of bytes other than ASCII white space, with A-Z in lower case.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Texts are hashed in blocks of so many bytes, so that a very long one needs little beside its words' hashes.
BLOCK = 1 << 19
_RANDOM = np.random.default_rng(20_240_117)
_BYTES = _RANDOM.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for a block."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(BLOCK + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block_words(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a block."""
    space = _SPACE[block]
    solid = ~space
    first, last = solid.copy(), solid.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers()
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum(_BYTES[block] * up[: len(block)], out=sums[1:])
    return starts, mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all words of lower-cased bytes. Words of a block and more are hashed by themselves."""
    a = np.frombuffer(data, np.uint8)
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(a):
        block = a[at : at + BLOCK]
        if len(block) == BLOCK:
            gaps = np.flatnonzero(_SPACE[block])
            if not len(gaps):
                end = at + BLOCK
                while end < len(a) and not _SPACE[a[end : end + BLOCK]].any():
                    end = min(len(a), end + BLOCK)
                if end < len(a):
                    end += int(np.argmax(_SPACE[a[end : end + BLOCK]]))
                digest = hashlib.blake2b(memoryview(data)[at:end], digest_size=8).digest()
                starts.append(np.array([at]))
                hashes.append(np.frombuffer(digest, np.uint64))
                at = end
                continue
            block = block[: gaps[-1] + 1]
        s, h = _block_words(block)
        starts.append(s + at)
        hashes.append(h)
        at += len(block)
    return np.concatenate(starts), np.concatenate(hashes)


def shingle_sets(texts: list[bytes], size: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of fewer words has one, of all its words."""
    data = b"\n".join(texts).lower()
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts, w = words(data)
    bounds = np.searchsorted(starts, edges)
    long = np.zeros(max(0, len(w) - size + 1), np.uint64)
    for j in range(size if len(long) else 0):
        long += w[j : len(w) - size + 1 + j] * _PLACES[j]
    long = mixed(long)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= size:
            own = np.sort(long[lo : hi - size + 1])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif hi > lo:
            whole = (w[lo:hi] * _PLACES[: hi - lo]).sum(dtype=np.uint64, keepdims=True)
            yield mixed(whole + _PLACES[size + hi - lo])
        else:
            yield np.zeros(0, np.uint64)
