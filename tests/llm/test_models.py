"""What the fitted models say, computed anew in plain Python from their parameters and the texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import quality_classifier as Q
from ledgerlens.llm import url_filter as U
from tests.llm.test_operators import TEXTS, docs


def word_shape(word):
    kinds = ["X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or k != kinds[i - 1])


def test_quality_scores_from_weights(spark):
    rows = [*TEXTS, (77, "Word" * 40 + "-1" * 90 + " and so on. The river ran past the mill, and no one saw it."), (78, "x1y2" * 100)]
    df = docs(spark, rows)
    model = Q.fit(df)
    votes = {r.t: r.q for r in df.select(F.col("text").alias("t"), model.column(F.col("text")).alias("q")).collect()}
    for _, t in rows:
        w = (t or "").split()
        z = model.bias + (sum(model.weights[zlib.crc32(b"s" + word_shape(x).encode()) % Q.BUCKETS] + model.weights[zlib.crc32(b"e" + x[-2:].lower().encode()) % Q.BUCKETS] for x in w) + model.weights[-1] * sum(a == b for a, b in zip(w, w[1:]))) / max(len(w), 1)
        want = 1 / (1 + math.exp(-min(max(z, -60), 60))) if w else 0.0
        assert votes[t].score == pytest.approx(want, abs=1e-12)
        assert votes[t].posterior == pytest.approx(model.posterior.get(votes[t].votes, model.share), abs=1e-12)
    kept = {r.doc_id for r in Q.keep_good(df).select("doc_id").collect()}
    assert kept == {r.doc_id for r in Q.judge(df).where("kept").collect()}


def test_tree_scores_from_nodes(spark):
    rng = np.random.default_rng(2)
    hosts = ["a.com", "b-c.net", "www.d.org", "shop.e.de", "f.info"]
    rows = []
    for k in range(600):
        h = hosts[int(rng.integers(0, 5))]
        rows.append((k, f"http{'s' if rng.random() < 0.5 else ''}://{h}/{'/'.join('pqr'[: int(rng.integers(0, 4))])}{int(rng.integers(0, 999))}{'?a=1&b=2' if rng.random() < 0.3 else ''}"))
    rows += [(1000, None), (1001, "no scheme"), (1002, rows[0][1])]
    rules = [("com", "/", "allow"), ("net", "/", "block"), ("org", "/p", "block"), ("de", "/", "allow")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    ruled = U._ruled(df, rules)
    model = U.fit(ruled)
    got = {r.page_id: r for r in U.judge(df, rules).collect()}
    rates = {r.suffix: r.rate for r in model.suffixes.collect()}
    assert model.trees

    def leaf(node, x):
        while isinstance(node, tuple):
            f, t, left, right = node
            node = left if x[f] <= t else right
        return node

    for i, url in rows:
        u = url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, after = rest[:cut].lower(), rest[cut:]
        path = after.split("?")[0].split("#")[0]
        query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
        n = len(u)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(u).values()) if n else 0.0
        one, two = host.split(".")[-1], ".".join(host.split(".")[-2:])
        x = [n, len(host), path.count("/"), len(path), sum(c.isdigit() for c in u) / max(n, 1), entropy, query.count("&") + 1 if query else 0, host.count("."), host.count("-"), u.startswith("https://"), rates.get(one, model.prior), rates.get(two, model.prior)]
        score = 1 / (1 + math.exp(-(model.base + sum(leaf(t, x) for t in model.trees))))
        assert got[i].score == pytest.approx(score, abs=1e-9), url
        if got[i].rule is None:
            assert got[i].verdict == ("block" if score >= 0.5 else "allow")
