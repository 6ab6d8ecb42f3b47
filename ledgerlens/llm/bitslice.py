"""Hamming-radius search over 64-bit fingerprints stored as vertical bit planes.

Plane b holds bit b of many fingerprints, 64 lanes to a machine word. The distances of all lanes are updated
together: two planes at a time go through a carry-save adder into bit counters, overflow is sticky, and a
block is abandoned as soon as every lane exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SMALL = 48  # groups up to this size are compared pair by pair, many groups at a time
LANES = 1 << 16  # pairs compared at a time
QUERIES = 32

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def planes(x: np.ndarray) -> np.ndarray:
    """(64, words) bit planes of unsigned 64-bit values; lanes beyond the last value are zero."""
    n = -(-len(x) // 64) * 64
    padded = np.zeros(n, np.uint64)
    padded[: len(x)] = x
    bits = np.unpackbits(padded.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(differing: Iterable[np.ndarray], radius: int) -> np.ndarray | None:
    """Mask of the lanes with at most radius set bits over the 64 planes; None once all lanes exceed it."""
    width = max(1, radius.bit_length())
    count: list[np.ndarray] = []
    over = None
    it: Iterator[np.ndarray] = iter(differing)
    for k, (a, b) in enumerate(zip(it, it, strict=True)):
        if not count:
            count = [np.zeros_like(a) for _ in range(width)]
            over = np.zeros_like(a)
        half = count[0] ^ a
        carry = (count[0] & a) | (half & b)
        count[0] = half ^ b
        for c in range(1, width):
            carry, count[c] = count[c] & carry, count[c] ^ carry
        over |= carry
        if k % 4 == 3 and k >= 7 and bool(np.all(_exceeds(count, over, radius) == FULL)):
            return None
    return ~_exceeds(count, over, radius)


def _exceeds(count: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is over radius, by a bitwise comparison from the high bit down."""
    more, same = over.copy(), ~over
    for c in reversed(range(len(count))):
        if radius >> c & 1:
            same &= count[c]
        else:
            more |= same & count[c]
            same &= ~count[c]
    return more


def _set_lanes(mask: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little")[:n])


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Positions at which a and b differ in at most radius bits."""
    out = []
    for k in range(0, len(a), LANES):
        x = a[k : k + LANES] ^ b[k : k + LANES]
        if (mask := within(planes(x), radius)) is not None:
            out.append(k + _set_lanes(mask, len(x)))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most radius differing bits) within one group."""
    n, p = len(fp), planes(fp)
    label, edges = np.arange(n), []
    bits = np.where((fp[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), FULL, np.uint64(0))
    for i in range(0, n, QUERIES):
        w = i // 64
        mask = within((p[b][None, w:] ^ bits[b, i : i + QUERIES, None] for b in range(64)), radius)
        if mask is None:
            continue
        for q in range(mask.shape[0]):
            at = i + q
            near = 64 * w + _set_lanes(mask[q], n - 64 * w)
            near = near[label[near] != label[at]]
            roots, first = np.unique(label[near], return_index=True)
            for r, j in zip(roots, near[first], strict=True):
                edges.append((at, int(j)))
                label[label == r] = label[at]
    return edges


def links(key_start: np.ndarray, ids: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) of consecutive groups; key_start: the groups' first rows and the total."""
    size = np.diff(key_start)
    a, b = [], []
    for g in np.flatnonzero(size > SMALL):
        lo, hi = key_start[g], key_start[g + 1]
        for i, j in forest(fp[lo:hi], radius):
            a.append(ids[lo + i])
            b.append(ids[lo + j])
    left, right = [], []
    for s in np.unique(size[(size > 1) & (size <= SMALL)]):
        i, j = np.triu_indices(s, 1)
        lo = key_start[:-1][size == s]
        left.append((lo[:, None] + i).ravel())
        right.append((lo[:, None] + j).ravel())
    if left:
        left, right = np.concatenate(left), np.concatenate(right)
        hit = close_pairs(fp[left], fp[right], radius)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for x, y in zip(left[hit].tolist(), right[hit].tolist(), strict=True):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[ry] = rx
                a.append(ids[x])
                b.append(ids[y])
    return np.array(a, np.int64), np.array(b, np.int64)
