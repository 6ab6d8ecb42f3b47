"""Every operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import bpe_stream, exact_dedup, language_model, packing, quality_classifier, quality_rules, simhash, token_files, url_filter, warc
from ledgerlens.llm.queries import BYTE_BPE, WORD_BPE, vocabulary

#: Names that operators use inside; as columns of the input they must not disturb them.
CLASH = ["key", "fp", "sha", "part", "ids", "m", "rule", "verdict", "win"]
DOC = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASH)
BASE = "The river ran past the old mill and the people of the town walked along it every evening until the lamps were lit. "
TEXTS = [
    (1, BASE * 2),
    (2, BASE * 2),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "One two three."),
    (7, BASE + "A second sentence stands here, alone."),
    (8, BASE + "A second sentence stands there, alone."),
    (9, "aé ß 漢字 \U0001f600 don't WE'LL  x  "),
    (10, "word " * 400),
    (11, "x" * 5000),
    (12, "alpha | beta | gamma | delta | epsilon | zeta | eta | theta | iota | kappa"),
    (13, "<|endoftext|> and <|startoftext|>\x1c here"),
    (None, "A row without an id, but with ten words in it at least, see."),
    (7, BASE + "A second sentence stands here, alone."),  # a repeated row
    (15, "Lots of MORE\ntext on\nlots of MORE\nlines " * 30),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, None, *["x"] * len(CLASH)) for i, t in rows], DOC).repartition(3)


def stable(spark, rows=TEXTS, tmp=[0]):
    """A written table, as stages get it."""
    from ledgerlens.llm.common import materialize

    return materialize(docs(spark, rows), "test-docs")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def ids(kind, t):
    return Tokenizer.from_file(vocabulary(kind)).encode(t or "", add_special_tokens=False).ids


def packed(x):
    return np.asarray(x, "<u4").tobytes()


def same(rows, want):
    assert Counter(map(tuple, rows)) == Counter(want)


def test_bpe_stream(spark):
    out = bpe_stream.round_trip(docs(spark), vocabulary(BYTE_BPE)).collect()
    tk = Tokenizer.from_file(vocabulary(BYTE_BPE))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(e := ids(BYTE_BPE, t)), sha(packed(e)), sha(tk.decode(e, skip_special_tokens=False).encode())) for i, t in TEXTS]
    same(out, want)
    assert bpe_stream.round_trip(docs(spark, []), vocabulary(BYTE_BPE)).count() == 0
    back = bpe_stream.decode(bpe_stream.encode(docs(spark), vocabulary(BYTE_BPE)), vocabulary(BYTE_BPE))
    same(back.collect(), [(i, t or "") for i, t in TEXTS])


def test_bpe_lookahead_and_runs():
    s = bpe_stream.BytePairStream(vocabulary(BYTE_BPE))
    assert 0 < s.machine.lookahead < 1000
    tk = Tokenizer.from_file(vocabulary(BYTE_BPE))
    for t in ("a" * 30000, "the" * 9000, " " * 9000 + "x", "\n " * 4000, "é" * 9000, "!" * 9000 + "'s", "1" * 70000, "x" * 65530 + "<|endoftext|>y", "\U0001f600" * 9000):
        assert s.encode(t) == packed(tk.encode(t, add_special_tokens=False).ids)
    d = s.decoder()  # broken sequences become U+FFFD, as soon as they are known to be broken
    table = [b"\xe2", b"\x82", b"\xac", b"a"]
    d.table = table
    assert d.feed([0]) == "" and d.feed([1]) == "" and d.feed([2, 3, 0]) == "€a" and d.feed([3]) == "\ufffda" and d.finish() == ""


def test_bpe_ids_leave_through_the_transducer(monkeypatch):
    """All ids come out of step, before their pretoken ends once stable, whatever the text's cuts and the table's size."""
    tk = Tokenizer.from_file(vocabulary(BYTE_BPE))
    s = bpe_stream.BytePairStream(vocabulary(BYTE_BPE))
    tiny = bpe_stream.BytePairStream(vocabulary(BYTE_BPE))
    tiny.machine.states = 3
    left, pending, step = [], [], s.machine.step

    def watched(state, byte):
        ids, after = step(state, byte)
        left.append((len(ids) // 4, byte))
        pending.append(len(after.pending))
        return ids, after

    s.machine.step = watched
    monkeypatch.setattr(bpe_stream.State, "__missing__", lambda state, byte: state.machine.step(state, byte))  # nothing is remembered, so that every byte is a step
    rng = np.random.default_rng(6)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'ll", "é", "ß", "漢字", "1", "23", "!", "<|endoftext|>", "<|", "x" * 300, "\u3000", "\U0001f600", "ing", "tion", "\xa0", "аба"]
    for _ in range(300):
        t = "".join(rng.choice(parts, rng.integers(0, 40)))
        want = packed(tk.encode(t, add_special_tokens=False).ids)
        left.clear()
        cuts = [0, *sorted(rng.integers(0, len(t) + 1, 4).tolist()), len(t)]
        assert b"".join(s.feed(t[i:j]) for i, j in zip(cuts, cuts[1:])) + s.finish() == want == tiny.encode(t)
        assert sum(n for n, _ in left) == len(want) // 4 - t.count("<|endoftext|>")
    assert max(pending) <= s.machine.lookahead + max(map(len, s.table))
    left.clear()
    s.encode("unbelievableabcdefgh" * 20)
    assert sum(n for n, b in left if b != bpe_stream.END) > 10 * sum(n for n, b in left if b == bpe_stream.END)


def test_token_files(spark):
    out = token_files.write_and_read(docs(spark), vocabulary(WORD_BPE)).collect()
    at, want = 0, []
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        want.append(r.doc_id)
    assert want == sorted(want, key=lambda i: (i is not None, i or 0))
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in out], [(i, len(e := [*ids(WORD_BPE, t), 1]), zlib.crc32(packed(e))) for i, t in TEXTS])
    assert token_files.write_and_read(docs(spark, []), vocabulary(WORD_BPE)).count() == 0


def test_token_codes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 1001):
        r = rng.choice([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], n).astype(np.uint32)
        assert token_files.unpack(*token_files.pack(r), n).tolist() == r.tolist()


def test_packing(spark):
    capacity = 64
    out = packing.pack(docs(spark), vocabulary(WORD_BPE), capacity=capacity, keep_ids=True).collect()
    want = []
    for i, t in TEXTS:
        e = [*ids(WORD_BPE, t), 0]
        want += [(i, p // capacity, p, len(x := e[p : p + capacity]), zlib.crc32(packed(x))) for p in range(0, len(e), capacity)]
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out], want)
    by = defaultdict(list)
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    assert packing.pack(docs(spark, []), vocabulary(WORD_BPE)).count() == 0


def kneser_ney(train, order):
    """log10 p(word | words before it) by dictionaries, and the distribution's support."""
    grams = Counter(tuple(p[i - order + 1 : i + 1]) for t in train for p in [["<s>"] * (order - 1) + t] for i in range(order - 1, len(p)))
    levels = {order: grams}
    for n in range(order - 1, 0, -1):
        c = Counter()
        for g, k in levels[n + 1].items():
            c[g[1:]] += k if g[1] == "<s>" else 1
        levels[n] = c
    d = {n: language_model.discounts(*[sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for n, c in levels.items()}
    after, total = defaultdict(Counter), Counter()
    for n, c in levels.items():
        for g, v in c.items():
            after[n, g[:-1]][min(v, 3)] += 1
            total[n, g[:-1]] += v
    vocabulary = {w for t in train for w in t}

    def p(context, w):
        out = 1 / (len(vocabulary) + 1)
        for n in range(1, order + 1):
            h = tuple(context[len(context) - n + 1 :])
            if t := total[n, h]:
                c = levels[n][(*h, w)]
                out = ((c - d[n][min(c, 3) - 1] if c else 0) + sum(d[n][k - 1] * m for k, m in after[n, h].items()) * out) / t
        return out

    return p, vocabulary


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model(spark, order, monkeypatch):
    if order == 4:  # many ranges per shard, small buffers, frequent words that are all but rare ones
        for name, value in (("SHARD_INPUT", 1), ("SHARDS", 3), ("TOKENS", 50), ("SLICE", 200), ("FREQUENT", 40)):
            monkeypatch.setattr(language_model, name, value)
        monkeypatch.setattr(language_model, "shuffle_partitions", lambda spark: 3)
    more = TEXTS + [(200 + k, " ".join(BASE.split()[k % 9 : k % 9 + 12])) for k in range(40)]
    out = language_model.score_held_out(docs(spark, more), order).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    tok = [(i, held(i), [*words(lower(t)), None]) for i, t in more]
    train = [t for _, h, t in tok if not h]
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    p, vocabulary = kneser_ney(train, order)
    want = {}
    for i, h, t in tok:
        padded = ["<s>"] * (order - 1) + t
        s = sum(math.log10(p(padded[k : k + order - 1], w)) for k, w in enumerate(t))
        want[i] = (h, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), s)
    assert len(out) == len(more)
    for r in out:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4]) and r.score == pytest.approx(want[r.doc_id][5])
    assert language_model.score_held_out(docs(spark, []), order).count() == 0
    # the distribution sums to one over the vocabulary and one unseen word
    context = ["ran", "past", "the"][4 - order :] if order > 1 else []
    assert sum(p(context, w) for w in vocabulary) + p(context, "\0unseen") == pytest.approx(1)


def test_language_model_adds_up_wide_ids_without_lexsort(monkeypatch):
    """Ids of over 64 bits together are laid into one key as ranks; both ways of adding up against a plain count."""
    rng = np.random.default_rng(5)
    some = np.concatenate([rng.integers(0, 1 << 32, 40), [0, (1 << 32) - 1]]).astype(np.uint32)
    columns = [some[rng.integers(0, len(some), 20_000)] for _ in range(3)]
    numbers = [np.where(rng.random(20_000) < 0.8, 1, rng.integers(0, 900, 20_000)), rng.integers(0, 5, 20_000)]

    def refused(*_):
        raise AssertionError("lexsort")

    monkeypatch.setattr(np, "lexsort", refused)
    for own in (numbers[:1], numbers):
        want = {}
        for *row, i in zip(*(c.tolist() for c in columns), range(20_000), strict=True):
            want[tuple(row)] = [a + int(v[i]) for a, v in zip(want.get(tuple(row), [0] * len(own)), own, strict=True)]
        rows, sums = language_model._added_up(columns, own)
        assert [c.dtype for c in rows] == [np.uint32] * 3
        assert list(zip(*(c.tolist() for c in rows), strict=True)) == sorted(want)
        assert [list(x) for x in zip(*(v.tolist() for v in sums), strict=True)] == [want[k] for k in sorted(want)]


def test_language_model_adds_up_ids_too_wide_for_ranks():
    columns = [np.arange(1 << 13, dtype=np.uint64)[::-1] * np.uint64(1 << 40) for _ in range(5)]
    rows, (sums,) = language_model._added_up([np.tile(c, 2) for c in columns], [np.arange(2 << 13)])
    assert all(np.array_equal(r, c[::-1]) for r, c in zip(rows, columns, strict=True))
    assert sums.tolist() == [2 * k + (1 << 13) for k in range(1 << 13)][::-1]


def test_language_model_order_is_the_stable_argsort():
    rng = np.random.default_rng(6)
    every = np.uint64((1 << 64) - 1)
    for keys in (rng.integers(0, 1 << 64, 5000, np.uint64), rng.integers(0, 9, 5000, np.uint64), every - rng.integers(0, 900, 5000, np.uint64), np.zeros(3, np.uint64), np.array([every]), np.empty(0, np.uint64)):
        assert np.array_equal(language_model._order(keys), np.argsort(keys, kind="stable"))
        own, at = language_model._distinct(keys)
        assert np.array_equal(own, np.unique(keys)) and np.array_equal(own[at], keys)



def test_counts_beyond_a_byte(spark):
    v = np.array([0, 1, 254, 255, 256, 1 << 40], np.int64)
    stored = language_model._narrow("n", v)
    assert language_model._wide(stored, "n", np.array([5, 0, 3, 4, 2, 1])).tolist() == [1 << 40, 0, 255, 256, 254, 1]


def simhash_of(t, k):
    w = words(lower(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    out = simhash.link_documents(docs(spark)).collect()
    fp = [simhash_of(t, 4) for _, t in TEXTS]
    label = list(range(len(fp)))
    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    low = {g: min((i for (i, _), x in zip(TEXTS, label) if x == g and i is not None), default=None) for g in label}
    same(out, [(i, f"{f:016x}", low[g]) for (i, _), f, g in zip(TEXTS, fp, label)])
    assert simhash.link_documents(docs(spark, [])).count() == 0


def test_simhash_splits_hot_keys(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    fps = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 40, (300, 2))} | {int(x) for x in rng.integers(0, 2**62, 100)}
    rows = spark.createDataFrame([(0, f, f) for f in sorted(fps)], "key long, id long, fp long")
    for chunk in (16, 1000):
        links = simhash.bucket_links(rows, 4, chunk=chunk).collect()
        assert all((a ^ b).bit_count() <= 4 for a, b in links)
        label = {f: f for f in fps}
        for a, b in links:
            x, y = label[a], label[b]
            label = {k: y if v == x else v for k, v in label.items()}
        want = {f: f for f in fps}
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and want[a] != want[b]:
                    x, y = want[a], want[b]
                    want = {k: y if v == x else v for k, v in want.items()}
        assert sorted(Counter(label.values()).values()) == sorted(Counter(want.values()).values())


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{k}" for k in range(900)]
    rows = []
    for k in range(40):
        t = rng.choice(vocab, 150).tolist()
        rows.append((10 * k, " ".join(t)))
        for c in range(k % 4):
            u = list(t)
            for at in rng.integers(0, 150, 1 + 2 * c):
                u[at] = "changed"
            rows.append((10 * k + c + 1, " ".join(u)))
    rows += [(None, None), (1000, ""), (1001, "  ")]
    shingles = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(lower(t))) else frozenset() for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(shingles):
        for j, b in enumerate(shingles[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = label[i], label[j]
                label = [y if v == x else v for v in label]
    want = [min((r for r, v in zip(rows, label) if v == g), key=lambda r: (r[0] is None, r[0] or 0))[0] for g in set(label)]
    kept = simhash.drop_near(stable(spark, rows))
    assert kept.columns == docs(spark).columns
    same([(r.doc_id,) for r in kept.collect()], [(i,) for i in want])
    assert simhash.drop_near(stable(spark, [])).count() == 0


def test_quality_rules(spark):
    out = {r.doc_id: r for r in quality_rules.judge(docs(spark)).collect()}
    for i, t in TEXTS:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        covered = {k + o for k, x in enumerate(windows) if n[x] > 1 for o in range(5)}
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
    assert out[7].kept and not out[12].kept and not out[12].base_failed and not out[3].kept
    kept = quality_rules.keep_good(docs(spark))
    assert kept.columns == docs(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality_rules.judge(docs(spark)).collect() if r.kept)
    assert quality_rules.judge(docs(spark, [])).count() == 0


def test_exact_dedup(spark):
    size, top = Counter(t or "" for _, t in TEXTS), {}
    for i, t in TEXTS:
        top[t or ""] = max(top.get(t or "", -1), -1 if i is None else i)
    for support in (0.5, 0.1, 0.001):
        out = exact_dedup.mark_exact(docs(spark), support).collect()
        same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out], [(i, None if top[t or ""] < 0 else top[t or ""], size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in TEXTS])
        assert Counter(r.text_sha256 for r in out if r.kept) == Counter({r.text_sha256 for r in out})
        assert all(r.doc_id == r.keep_id for r in out if r.kept)
    kept = exact_dedup.drop_exact(stable(spark))
    assert kept.columns == docs(spark).columns and Counter(r.text or "" for r in kept.collect()) == Counter(size.keys())
    assert exact_dedup.mark_exact(docs(spark, [])).count() == 0


def test_quality_classifier(spark):
    rng = np.random.default_rng(1)
    w = [f"{a}{b}" for a in ("ma", "te", "rio", "lan", "ve") for b in ("ne", "sol", "rin", "ta", "per", "don")]
    rows, junk = [], set()
    for k in range(240):
        t = rng.choice(w, 40).tolist()
        bad = k % 6 == 0
        if bad:
            junk.add(k)
            t = [[x + "***" for x in t], [x.upper() + "!!" for x in t], [x + " |" for x in t], [x for x in t[:5] for _ in range(8)]][k // 6 % 4]
        rows.append((k, " ".join(t).capitalize() + "." if not bad else " ".join(t)))
    rows += [(1000, None), (1001, "")]
    out = {r.doc_id: r for r in quality_classifier.judge(docs(spark, rows)).collect()}
    right = sum(out[k].kept == (k not in junk) for k in range(240))
    assert right >= 235 and all(out[k].kept for k in range(240) if k not in junk)
    assert not out[1000].kept and not out[1001].kept
    clean = [r for r in rows[:240] if r[0] not in junk]
    assert quality_classifier.keep_good(docs(spark, clean)).count() == len(clean)  # a corpus of one class isn't split
    assert quality_classifier.keep_good(docs(spark, clean)).columns == docs(spark).columns
    assert quality_classifier.judge(docs(spark, [])).count() == 0


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(20000) < 0.8
    right = rng.random((20000, 6)) < np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9])
    votes = np.where(rng.random((20000, 6)) < 0.2, 2, np.where(right, truth[:, None], ~truth[:, None]))
    patterns, count = np.unique(votes, axis=0, return_counts=True)
    post, rates, share = quality_classifier.expectation_maximisation(patterns, count.astype(float))
    assert share == pytest.approx(0.8, abs=0.02)
    assert quality_classifier.accuracies(rates)[1] == pytest.approx([0.95, 0.9, 0.85, 0.8, 0.75, 0.9], abs=0.03)


PAGES = [
    (1, "https://a.example.org/en/25#top"),
    (2, "http://A.Example.ORG/es/x?y=1"),
    (3, "https://x.com/fr/1"),
    (4, "https://x.com/de/"),
    (5, "https://x.com"),
    (6, "no scheme.org/es/"),
    (7, None),
    (8, "https://example.org/en/100"),
    (9, "http://xexample.org/es/1"),
    (10, "ftp://net?q#://org/"),
    (10, "ftp://net?q#://org/"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(i, u, None, "a", "b", "c") for i, u in rows], "page_id long, url string, html string, host string, rule string, suffix1 string")


def test_url_rules(spark):
    def want(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best and best[2]

    out = url_filter.judge(pages(spark)).collect()
    assert len(out) == len(PAGES)
    for r in out:
        host, path, rule, verdict = want(dict(PAGES)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.judge(pages(spark, [])).count() == 0


def test_url_trees_learn_held_out(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(900):
        bad = k % 3 == 0
        host = f"{'x' * int(rng.integers(9, 15))}-{int(rng.integers(100, 999))}.biz" if bad else f"{'site'[: int(rng.integers(2, 5))]}.com"
        rows.append((k, f"https://{host}/{'a/' * int(rng.integers(0, 3))}{'?p=1&q=2&r=3' if bad else ''}"))
    df = spark.createDataFrame(rows, "page_id long, url string")
    host, path = url_filter.host_path(F.col("url"))
    split = df.select("page_id", "url", host.alias("host"), path.alias("path"))
    truth = F.when(F.col("page_id") % 3 == 0, "block").otherwise("allow")
    model = url_filter.fit(split.withColumn("verdict", F.when(F.col("page_id") < 600, truth)))
    scored = url_filter.with_suffix_rates(url_filter.with_lexical(split), model.suffixes, model.prior).withColumn("p", model.score())
    right = scored.where("page_id >= 600").select(((F.col("p") >= 0.5) == (truth == "block")).alias("ok")).where("ok").count()
    assert right >= 285


def test_warc(spark, tmp_path):
    html = "<html><title>A &amp; B</title><body><script>no()</script><p>One <b>two</b></p><a href='/x'>three</a></body></html>"
    rows = [(1, "http://a.org/", html), (2, None, None), (3, "http://b.org/\r\nx", "plain text"), (None, "u", "é" * 70000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, record string")
    out = {r.page_id: r for r in warc.summary(df).collect()}
    assert len(out) == 4 and all(r.digest_agrees for r in out.values())
    assert out[1].title == "A & B" and out[1].n_links == 1 and out[1].text_sha256 == hashlib.sha256("A & B\nOne two\nthree".encode()).hexdigest()
    assert out[2].n_chars == 0 and out[None].n_chars == 70000
    records = warc.responses(df)
    files = warc.write_records(records, f"file://{tmp_path}/w").collect()
    assert sum(f.n_records for f in files) == 4
    back = warc.derive(warc.read_records(spark, f"file://{tmp_path}/w"))
    got = {warc.get(next(warc.parse(r.metadata))[0], "WARC-Refers-To") for r in back.collect()}
    assert got == {r.response_id for r in out.values()}
    for r in back.collect():
        (h, block), (mh, about), (ch, text) = (next(warc.parse(x)) for x in (r.record, r.metadata, r.conversion))
        assert warc.get(mh, "WARC-Refers-To") == warc.get(ch, "WARC-Refers-To") == warc.get(h, "WARC-Record-ID")
        assert f"source-warc-payload-digest: {warc.get(h, 'WARC-Payload-Digest')}".encode() in about
        assert warc.get(ch, "WARC-Block-Digest") == warc.digest(text)
    assert warc.derivatives([("WARC-Type", "request")], b"") is None
    assert all(r.error is None for r in back.collect())
    assert warc.summary(df.where("false")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t) for i, t in TEXTS] + [(100 + k, BASE + f"Sentence number {k} closes this text, which no other text repeats, at word {k * 7}.") for k in range(20)]
    d = tmp_path / "sf"
    docs(spark, rows).write.parquet(f"file://{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "exact dedup", "near dedup", "packing"]
    out = corpus_pipeline.run(spark, f"file://{d}")
    kept = {r.doc_id for r in out.collect()}
    assert 3 not in kept and 12 not in kept and 10 not in kept and len({1, 2} & kept) <= 1
    texts = dict(rows)
    assert all(texts[i] for i in kept)


def test_pipeline_stages_with_odd_tables(spark, tmp_path):
    """Empty tables, columns of clashing names and a very long text, through every stage and through run."""
    import corpus_pipeline

    rng = np.random.default_rng(4)
    vocab = ["river", "mill", "lamp", "town", "people", "evening", "market", "bridge", "the", "and", "of", "a", "in", "to", "was", "were"]
    words_ = [str(w) for w in rng.choice(vocab, 60000)]
    long = ". ".join(" ".join(words_[k : k + 12]).capitalize() + f" {k}" for k in range(0, 60000, 12)) + "."
    rows = [(i, t) for i, t in TEXTS if i is not None] + [(500, long), (501, long)]
    for name, rows_ in (("odd", rows), ("empty", [])):
        stage_docs = stable(spark, rows_)
        for step, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, stage_docs, "").collect()
            ids = {r.doc_id for r in out}
            assert ids <= {i for i, _ in rows_} and stage(spark, stage_docs, "").columns == stage_docs.columns, step
            assert all(r[c] == "x" for r in out for c in CLASH), step
        d = tmp_path / name
        docs(spark, rows_).write.parquet(f"file://{d}/documents.parquet")
        packed_ = corpus_pipeline.run(spark, f"file://{d}").collect()
        if name == "empty":
            assert packed_ == []
        else:
            assert 500 not in {r.doc_id for r in packed_}  # of equal texts the largest id stays
            longest = [r for r in packed_ if r.doc_id == 501]
            assert not longest or sum(r.length for r in longest) == len(ids_of(long)) + 1


def ids_of(text):
    return ids(WORD_BPE, text)


def test_pipeline_leaves_two_tables(spark, tmp_path):
    import os

    import corpus_pipeline
    from ledgerlens.storage import work_folder

    folder = work_folder(spark).removeprefix("file://")
    docs(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert left <= {"pieces", "piece-ranks"} and out.count() > 0


def test_quality_scores_rank_the_labels(spark):
    """Area under the curve of the score against the table of quality labels, which the classifier never reads."""
    from pathlib import Path

    folder = Path("/root/testdata/sf0.001")
    if not folder.exists():
        pytest.skip("no test tables")
    scored = quality_classifier.judge(spark.read.parquet(f"{folder}/documents.parquet")).select("doc_id", "score")
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    won = sum((g > b) + (g == b) / 2 for g in good for b in bad)
    assert good and bad and won >= 0.97 * len(good) * len(bad)
