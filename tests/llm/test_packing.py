"""Packing: dominance reduction and best fit against exact minima; placement is a partition."""

import random
from functools import lru_cache

import numpy as np

from ledgerlens.llm import packing as P


def exact(items, capacity):
    """Fewest sequences, by exhaustive search."""

    @lru_cache(None)
    def go(rest):
        if not rest:
            return 0
        first, others = rest[0], rest[1:]
        best = 99
        seen = set()

        def fill(k, room, left):
            nonlocal best
            left_t = tuple(left)
            if left_t not in seen:
                seen.add(left_t)
                best = min(best, 1 + go(left_t))
            for i in range(k, len(left)):
                if left[i] <= room and (i == k or left[i] != left[i - 1]):
                    fill(i, room - left[i], left[:i] + left[i + 1 :])

        fill(0, capacity - first, list(others))
        return best

    return go(tuple(sorted(items, reverse=True)))


def test_reduction_keeps_an_optimum():
    rng = random.Random(1)
    for _ in range(120):
        c = rng.choice([10, 17, 24])
        items = [rng.randint(1, c) for _ in range(rng.randint(1, 9))]
        count = np.bincount(items, minlength=c + 1).astype(np.int64)
        fixed = P.reduce_instance(count, c)
        rest = [s for s in range(c + 1) for _ in range(count[s])]
        assert sorted(rest + [p for n, ps in fixed for p, t in ps for _ in range(n * t)]) == sorted(items)
        assert sum(n for n, _ in fixed) + exact(rest, c) == exact(items, c)


def test_plan_fits_and_is_near_the_bound():
    rng = random.Random(2)
    for c, most in ((64, 5000), (2048, 20000)):
        items = [min(c, int(rng.expovariate(1 / (c / 3))) + 1) for _ in range(most)]
        groups = P.plan({s: items.count(s) for s in set(items)}, c)
        assert all(sum(p * t for p, t in ps) <= c for _, ps in groups)
        assert sorted(p for n, ps in groups for p, t in ps for _ in range(n * t)) == sorted(items)
        assert sum(n for n, _ in groups) <= 1.01 * sum(items) / c + 2


def test_places_are_gapless():
    rng = random.Random(3)
    items = [rng.randint(1, 40) for _ in range(500)]
    table = P.intervals(P.plan({s: items.count(s) for s in set(items)}, 40))
    seen, rank = {}, []
    for s in items:
        rank.append(seen.get(s, 0))
        seen[s] = rank[-1] + 1
    seq, off = P.place(table, np.array(items), np.array(rank))
    by = {}
    for s, q, o in zip(items, seq, off):
        by.setdefault(int(q), []).append((int(o), s))
    for parts in by.values():
        at = 0
        for o, s in sorted(parts):
            assert o == at
            at += s
        assert at <= 40
