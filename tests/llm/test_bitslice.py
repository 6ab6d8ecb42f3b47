"""Bit-sliced search against plain popcounts."""

import numpy as np

from ledgerlens.llm import bitslice as B


def close(a, b, r):
    return np.bitwise_count(a ^ b) <= r


def test_close_pairs():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    flips = np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 12), replace=False)) for _ in a], np.uint64)
    for r in (0, 1, 3, 4, 7, 8, 12, 24):
        assert B.close_pairs(a, a ^ flips, r).tolist() == np.flatnonzero(close(a, a ^ flips, r)).tolist()
    assert not len(B.close_pairs(a, ~a, 4))


def component(n, edges):
    label = list(range(n))
    for a, b in edges:
        x, y = label[a], label[b]
        label = [x if v == y else v for v in label]
    return [label.index(v) for v in label]


def test_links_span_every_group():
    rng = np.random.default_rng(2)
    fp, starts = [], [0]
    for size in (1, 2, 3, 47, 48, 49, 200, 1, 5):
        base = rng.integers(0, 2**64, max(1, size // 5), dtype=np.uint64)
        flips = np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(size)], np.uint64)
        fp += (base[rng.integers(0, len(base), size)] ^ flips).tolist()
        starts.append(len(fp))
    fp = np.array(fp, np.uint64)
    a, b = B.links(np.array(starts), np.arange(len(fp)), fp, 4)
    want = [(i, j) for lo, hi in zip(starts, starts[1:]) for i in range(lo, hi) for j in range(i + 1, hi) if close(fp[i], fp[j], 4)]
    assert component(len(fp), zip(a.tolist(), b.tolist())) == component(len(fp), want)
    assert len(a) < len(fp) and all(close(fp[i], fp[j], 4) for i, j in zip(a, b))
