"""MinHash near-duplicates against all pairs of the whole table, and the guarantee of the multi-index join."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import minhash, similar_sets

SCHEMA = "doc_id long, text string, id string, root string, size string, digest string"


def shingles(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


def expected(rows):
    """Brute force: every pair of sets that share a shingle."""
    sets = [shingles(r[1]) for r in rows]
    at = list(range(len(rows)))

    def top(k):
        while at[k] != k:
            k = at[k]
        return k

    holders = {}
    for k, s in enumerate(sets):
        for other in {j for x in s for j in holders.get(x, ())}:
            both = len(s & sets[other])
            if 100 * both >= 85 * len(s | sets[other]):
                at[top(k)] = top(other)
        for x in s:
            holders.setdefault(x, []).append(k)
    low = {}
    for k, r in enumerate(rows):
        low.setdefault(top(k), []).append(r[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return sorted(((r[0], len(s), low[top(k)], r[0] == low[top(k)]) for k, (r, s) in enumerate(zip(rows, sets, strict=True))), key=str)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(3)
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.link_documents(df).collect()]
    assert sorted(got, key=str) == expected(rows)


def versions(rng, n, words, edits):
    vocab = [f"W{k}é" if k % 9 == 0 else f"w{k}" for k in range(5000)]
    base = rng.choice(vocab, words).tolist()
    out = []
    for _ in range(n):
        t = list(base)
        for at in rng.integers(0, words, int(rng.integers(0, edits + 1))):
            t[at] = vocab[int(rng.integers(0, 5000))]
        out.append("\t ".join(t))
    return out


def test_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    texts = [None, "", " \n", "One", "one", "ONE two", "one two", "one two three", "One two three", "one two three four", "x y " * 50, "x y " * 60, "word " * 30000, *["same text of six words here"] * 40]
    texts += versions(rng, 60, 120, 6) + versions(rng, 40, 30, 2) + versions(rng, 12, 4000, 300) + versions(rng, 30, 8, 1)
    order = rng.permutation(len(texts)).tolist()
    rows = [(order[k], t) for k, t in enumerate(texts)] + [(None, "one two three"), (None, "alone with no other row"), (3, texts[order.index(3)])]
    check(spark, rows)
    assert minhash.link_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chain_and_small_rounds(spark, monkeypatch):
    """A text that drifts: links lead from version to version, and most pairs of a key aren't alike."""
    for name, value in (("CHECKED", 5), ("COMPARED", 8), ("PARTNERS", 1)):
        monkeypatch.setattr(similar_sets, name, value)
    rng = np.random.default_rng(12)
    text, rows = [f"w{k}" for k in range(150)], []
    for k in range(150):
        text[int(rng.integers(0, 150))] = f"v{k}"
        rows.append((1000 - k, " ".join(text)))
    check(spark, rows)


def test_signatures_within_the_radius_share_a_key(spark):
    rng = np.random.default_rng(13)
    rows = []
    for k in range(300):
        a = rng.integers(0, 1 << 16, minhash.LANES).astype(np.uint16)
        b = a.copy()
        wrong = rng.choice(minhash.LANES, int(rng.integers(0, minhash.RADIUS + 1)), replace=False)
        b[wrong] ^= rng.integers(1, 1 << 16, len(wrong)).astype(np.uint16)
        far = b.copy()
        rest = np.setdiff1d(np.arange(minhash.LANES), wrong)[: minhash.RADIUS + 1 - len(wrong)]
        far[rest] ^= 1
        rows.append([x.view(np.int64).tolist() for x in (a, b, far)])
    like = minhash.LaneSignatures(3, 85)
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, far array<long>")
    a, b, far = (F.col(c) for c in ("a", "b", "far"))
    out = df.select(F.arrays_overlap(like.keys(a), like.keys(b)).alias("met"), like.close_rows(a, b).alias("near"), like.close_rows(a, far).alias("over")).collect()
    assert all(r.met and r.near and not r.over for r in out)
    x, y, z = (np.array([r[k] for r in rows]).view(np.uint64) for k in range(3))
    assert all(like.close(x[k : k + 1], y[k])[0] and not like.close(x[k : k + 1], z[k])[0] for k in range(300))


def test_documents(spark):
    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.link_documents(docs).collect()]
    assert sorted(got, key=str) == expected(rows)
