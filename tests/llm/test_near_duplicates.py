"""Near-duplicates whose shingles repeat, and the bound that leaves pairs out before the exact check."""

import numpy as np

from ledgerlens.llm import similar_sets, simhash
from ledgerlens.llm.common import materialize

LIKE = simhash.MinHashPairs(simhash.WORDS, simhash.PERCENT)


def groups(tagged):
    """Row id -> smallest id of its group."""
    return {r.id: r.root for r in similar_sets.members(tagged, LIKE).collect()}


def test_near_duplicates_with_other_repeat_counts(spark):
    rng = np.random.default_rng(7)
    vocab = [f"w{k}" for k in range(20000)]
    rows = []
    for k in range(8):
        t = rng.choice(vocab, 1000).tolist()
        more = ["again"] * 200 if k % 2 else "this line stands here many times".split() * 35
        rows += [(10 * k, " ".join(t)), (10 * k + 1, " ".join(t + more))]
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "test-near")
    assert sorted(r.doc_id for r in simhash.drop_near(docs).collect()) == [10 * k for k in range(8)]


def test_bound_leaves_out_no_similar_pair():
    rng = np.random.default_rng(8)
    left_out = 0
    for n in (1, 5, 40, 300, 3000):
        for share in (0, 0.1, 0.8, 8 / 9, 0.95, 1):
            own = rng.integers(0, 2**63, (3, n), dtype=np.uint64)
            both = own[0][: round(n * share)]
            a, b = (np.unique(np.concatenate([both, x[: n - len(both)]])) for x in own[1:])
            sketches = [np.frombuffer(similar_sets.odd_sketch(x), np.uint64) for x in (a, b)]
            may = LIKE.may_be_similar(*sketches, np.int64(len(a) + len(b)))
            similar = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
            assert may or not similar
            left_out += not may
    assert left_out >= 8  # and it does leave pairs out


def test_rounds_lose_no_link(spark, monkeypatch):
    """Small chunks and few partners at a time: components equal those of all pairs of the whole table."""
    monkeypatch.setattr(similar_sets, "CHECKED", 5)
    monkeypatch.setattr(similar_sets, "COMPARED", 8)
    monkeypatch.setattr(similar_sets, "PARTNERS", 1)
    rng = np.random.default_rng(9)
    vocab = [f"w{k}" for k in range(3000)]
    base = rng.choice(vocab, 200).tolist()
    rows = []
    for k in range(240):  # versions of one text that drift apart: similar to some of the others only
        if k % 3 == 0:
            base = list(base)
            for at in rng.integers(0, 200, 6):
                base[at] = vocab[int(rng.integers(0, 3000))]
        t = list(base)
        for at in rng.integers(0, 200, int(rng.integers(0, 4))):
            t[at] = "x"
        rows.append((k, " ".join(t)))
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("doc_id AS id", "doc_id", "text"), "test-near")
    sets = [np.unique(similar_sets.shingle_hashes(t, 5)) for _, t in rows]
    want = list(range(len(rows)))
    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if LIKE.are_similar(sets[i], sets[j]):
                links += 1
                x, y = want[i], want[j]
                want = [min(x, y) if v in (x, y) else v for v in want]
    got = groups(docs)
    assert links > 150 and 1 < len(set(want)) < 200
    assert [got.get(k, k) for k in range(len(rows))] == want


def test_recall_against_all_pairs_on_documents(spark):
    """Pairs of the test documents that are similar by brute force over shared shingles, and those in one group."""
    from pathlib import Path

    import pytest

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id AS id", "doc_id", "text")
    rows = docs.collect()
    sets = {r.id: np.unique(similar_sets.shingle_hashes(r.text, 5)) for r in rows}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if LIKE.are_similar(sets[a], sets[b])]
    got = groups(materialize(docs, "test-near"))
    found = sum(got.get(a) is not None and got.get(a) == got.get(b) for a, b in pairs)
    assert pairs and found >= 0.99 * len(pairs)


def test_pipeline_drops_what_fingerprints_link(spark):
    """The near stage keeps the smallest id of each component of SimHash fingerprints within 4 bits, by brute force."""
    import corpus_pipeline

    rng = np.random.default_rng(10)
    vocab = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(40):
        t = rng.choice(vocab, 300).tolist()
        for n, edits in enumerate((0, 1, 3, 12, 30)):
            own = list(t)
            for at in rng.integers(0, 300, edits):
                own[at] = "x"
            rows.append((5 * k + n, " ".join(own)))
    rows += [(1000, ""), (1001, None), (None, rows[0][1]), (0, rows[0][1])]
    fp = [simhash.fingerprint(similar_sets.shingle_hashes(t, 4)) & (2**64 - 1) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    want = sorted(min(rows[k][0] for k, r in enumerate(root) if r == x and rows[k][0] is not None) for x in set(root))
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "test-near")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()) == want
    assert 40 < len(want) < 200
