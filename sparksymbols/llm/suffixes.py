"""Sorting the suffixes of a block of bytes in two stages, and anchors that tell which blocks texts must meet in."""

from __future__ import annotations

import numpy as np

from sparksymbols.llm import shingles

GRAM = 18


def _words(t: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes from each place on as a number; zeros follow the end."""
    padded = np.concatenate([t, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    pairs = padded[:-1] << np.uint64(8) | padded[1:]
    fours = pairs[:-2] << np.uint64(16) | pairs[2:]
    return fours[:-4] << np.uint64(32) | fours[4:]


def smaller_than_successor(t: np.ndarray) -> np.ndarray:
    """Whether each suffix sorts before the next one; the last sorts after the empty one."""
    n = len(t)
    up = np.zeros(n, bool)
    up[:-1] = t[1:] > t[:-1]
    decided = np.ones(n, bool)
    decided[:-1] = t[1:] != t[:-1]
    nxt = np.where(decided, np.arange(n), n - 1)
    return up[np.minimum.accumulate(nxt[::-1])[::-1]]


def _direct(t: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that are smaller than their successors, sorted by their first ``depth`` bytes."""
    p = np.flatnonzero(smaller_than_successor(t))
    if not len(p):
        return p
    p = p[np.argsort(w[p], kind="stable")]
    new = np.ones(len(p) + 1, bool)
    new[1:-1] = w[p[1:]] != w[p[:-1]]
    for at in range(8, depth, 8):
        tied = np.flatnonzero(~(new[:-1] & new[1:]))
        if not len(tied):
            break
        group, key = np.cumsum(new[:-1])[tied], w[p[tied] + at]
        order = np.lexsort((key, group))
        p[tied] = p[tied][order]
        key = key[order]
        new[tied[1:]] |= (key[1:] != key[:-1]) | (group[1:] != group[:-1])
    return p


def two_stage_sort(t: np.ndarray, depth: int, w: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of ``t`` in the order of their first ``depth`` bytes.

    Only suffixes smaller than their successors are sorted directly. A scan of the buckets of first bytes, in order,
    induces the others: the suffix one place earlier belongs to the bucket of its first byte, after those before it.
    """
    if not len(t):
        return np.zeros(0, np.int64)
    w = _words(t, depth) if w is None else w
    direct = _direct(t, w, depth)
    ends = np.searchsorted(t[direct], np.arange(257))
    seeds: list[list[np.ndarray]] = [[] for _ in range(256)]
    seeds[t[-1]].append(np.array([len(t) - 1]))
    out = []
    for c in np.flatnonzero(np.bincount(t, minlength=256)):
        front = np.concatenate(seeds[c]) if seeds[c] else np.zeros(0, np.int64)
        bucket = []
        while len(front):
            bucket.append(front)
            front = front[front > 0] - 1
            front = front[t[front] == c]
        bucket.append(direct[ends[c] : ends[c + 1]])
        bucket = np.concatenate(bucket)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[t[before] > c]
        first = t[before]
        before = before[np.argsort(first, kind="stable")]
        cuts = np.searchsorted(np.sort(first, kind="stable"), np.arange(c + 1, 257))
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), c + 1):
            if hi > lo:
                seeds[k].append(before[lo:hi])
    return np.concatenate(out)


def shared_least(t: np.ndarray, eligible: np.ndarray, values: np.ndarray, length: int) -> np.ndarray:
    """For each eligible place the least value of all eligible places with the same ``length`` bytes.

    Eligible places have ``length`` bytes that belong together; adjacent suffixes with so long a common prefix do.
    """
    w = _words(t, length)
    order = two_stage_sort(t, length, w)
    order = order[eligible[order]]
    same = np.ones(max(0, len(order) - 1), bool)
    for at in range(0, length, 8):
        left = np.flatnonzero(same)
        a, b = w[order[left] + at], w[order[left + 1] + at]
        spare = np.uint64(8 * max(0, at + 8 - length))
        same[left] = (a >> spare) == (b >> spare)
    out = np.zeros(len(t), values.dtype)
    if len(order):
        starts = np.flatnonzero(np.concatenate([[True], ~same]))
        least = np.minimum.reduceat(values[order], starts)
        out[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
    return out


def anchors(t: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same anchor: first window, number of windows, hash of the anchor, text.

    ``t`` holds texts one after the other that end at ``ends``; windows are all strings of ``length`` bytes within
    a text. The anchor of a window is its ``GRAM``-byte string with the least hash, the leftmost of equal ones, so
    equal windows have equal anchors at the same place.
    """
    up, down = shingles.powers()
    grams = length - GRAM + 1
    step = shingles.BLOCK - length
    found = []
    for at in range(0, max(0, len(t) - length + 1), step):
        block = t[at : at + step + length - 1]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(shingles._BYTES[block] * up[: len(block)], out=sums[1:])
        h = shingles.mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(block) - GRAM + 1])
        low = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width < grams:
            reach = min(width, grams - width)
            low = np.minimum(low[: len(low) - reach], low[reach:])
            width += reach
        place = (low & np.uint64(0xFFFFF)).astype(np.int64)
        window = np.arange(at, at + len(place))
        text = np.searchsorted(ends, window, side="right")
        fits = window + length <= ends[np.minimum(text, len(ends) - 1)]
        window, place, text = window[fits], place[fits], text[fits]
        if len(window):
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
            # Least hashes are small numbers; mixed once more they are dealt evenly.
            found.append((window[first], np.diff(np.append(first, len(window))), shingles.mixed(~h[place[first]]), text[first]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))
