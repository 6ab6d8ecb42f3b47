"""Divergence of sources against exact arithmetic on the whole table, and the tournament that pairs the groups."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, block string, value string"


def expected(rows, least):
    terms, groups, spread = defaultdict(Counter), set(), defaultdict(set)
    for k, (_, text, lang, source, *_) in enumerate(rows):
        g = (lang or "", source or "")
        groups.add(g)
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            terms[g][t] += 1
            spread[g[0], t].add(k)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), s in spread.items() if x == lang and len(s) >= least)
        own = sorted(g for g in groups if g[0] == lang)

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p = {g: shares(terms[g]) for g in own}
        q = shares(sum((terms[g] for g in own), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for g in own:
            pairs = [(-sum(f(p[g][t], p[o][t]) for t in kept), o[1].encode()) for o in own if o != g]
            tops = [(-f(p[g][t], q[t]), t.encode()) for t in kept if terms[g][t] and p[g][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(tops)[:10])):
                out |= {(*g, part, item.decode(), -v, k) for k, (v, item) in enumerate(items, 1)}
    return out


def rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    vocab = ["Été", "étÉ", "naïve", "x", "Ωmega", "日本", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))]
    out = []
    for k in range(n):
        lang, source = ("en", "de", None)[int(rng.integers(0, 3))], f"s{min(int(rng.exponential(4)), 20)}" if rng.random() < 0.9 else None
        text = " 1-".join(rng.choice(vocab, int(rng.integers(0, 30))))
        out.append((k, text if k % 11 else None, lang, source, "a", "b", "c", "d"))
    out += [out[5]] * 12 + [(900, "lonely words here", "fr", "s1", "", "", "", ""), (901, "", "fr", "s2", "", "", "", ""), (902, "one " * 20000, "xx", "s1", "", "", "", "")]
    return out


@pytest.mark.parametrize(("blocks", "station", "least"), [(7, 2, 10), (1 << 15, 3, 1), (1 << 15, 8, 10)])
def test_against_whole_table(spark, blocks, station, least):
    data = rows()
    got = divergence.audit(spark.createDataFrame(data, SCHEMA).repartition(5), least, blocks, station).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == expected(data, least)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 10])
def test_every_two_stations_meet_once(spark, n):
    groups = spark.range(n).select(F.lit("x").alias("lang"), F.lit(0).alias("block"), F.col("id").cast("string").alias("source"), F.col("id").alias("station"), F.lit(n).cast("long").alias("stations"))
    met = Counter((r.at, r.station) for r in divergence.meetings(groups).collect() if r["round"] >= 0)
    assert set(met.values()) <= {1}
    assert Counter(tuple(sorted(x)) for x in met) == Counter(combinations(range(n), 2))


def test_shares_and_vectors():
    counts = np.array([0, 1, 5, 10**12, 7 * 10**14], np.int64)
    total = int(counts.sum()) + 2 * len(counts)
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts.tolist()]
    assert divergence.unpack(divergence.pack(np.array([1, 4, 9]), counts[2:]), 12).tolist() == [0, 5, 0, 0, 10**12, 0, 0, 0, 0, 7 * 10**14, 0, 0]
    assert divergence.unpack(None, 3).tolist() == [0, 0, 0]
