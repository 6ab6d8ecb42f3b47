"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on every text. The whole corpus is counted by
vote pattern (at most 3 ** labellers rows reach the driver), and expectation-
maximisation over that table estimates every labeller's accuracy per class and the share of good texts,
with Dirichlet priors that keep the classes from changing places and a corpus of one class from being split.
The posteriors are the training labels of a logistic model over hashed word shapes and word ends, averaged
over a text's words, so that texts are scored by what they look like and not only by the labellers' rules.
It is fitted on at most FIT_ROWS texts, those with the smallest hashes; every whole text is scored.

Cases: texts without words, null ones included, get score 0 and aren't kept. Labellers abstain where a text
is too short to judge. Equal texts get equal results. An empty table gives an empty result. Extra columns
are ignored by ``judge`` and carried by ``keep_good``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 5000
BUCKETS = 1 << 13
THRESHOLD = 0.5
REMEMBERED = 150_000
GOOD, BAD, NONE = 1, 0, 2
#: Dirichlet priors of a labeller's votes (bad, good, none) by the text's class, and of the corpus (bad, good), as pseudo-counts.
VOTE_PRIOR = {BAD: (25.0, 10.0, 65.0), GOOD: (0.5, 40.0, 59.5)}
CLASS_PRIOR = (2.0, 8.0)


LABELLERS = ("symbols", "plain_words", "capitals", "exclamations", "navigation", "separators", "repetition", "stutter", "sentences")
_ENDS = tuple(".!?…:;") + tuple(a + b for a in ".!?…:;" for b in "\"')»”")
_SEPARATORS = re.compile(r"[^|\n]\|[^|\n]+\|[^|\n]+\|[^|\n]")
_PLAIN = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*[.,;:]?")


def word_kind(word: str) -> int:
    """1 for a plain word plus 2 ** 32 for one in capitals; sums count both."""
    return bool(_PLAIN.fullmatch(word)) + (bool(len(word) > 1 and word.isupper()) << 32)


def votes(text: str, words: list[str], kinds: int) -> tuple[int, ...]:
    """The labellers' votes; kinds is the sum of word_kind over the words."""
    n = max(len(words), 1)
    enough = len(words) >= 8
    plain, capitals = kinds & 0xFFFFFFFF, kinds >> 32
    lines = [x for x in map(str.rstrip, text.split("\n")) if x]
    ended = sum(x.endswith(_ENDS) for x in lines) / max(len(lines), 1)
    pipes = text.count("|")
    said = (
        (False, sum(map(text.count, "#*$%&<>")) > 0.3 * n),
        (plain > 0.8 * n, plain < 0.5 * n),
        (False, enough and capitals > 0.5 * n),
        (False, text.count("!") > 0.3 * n),
        (False, enough and pipes > 0.15 * n),
        (False, pipes > 2 and bool(_SEPARATORS.search(text))),
        (False, enough and len(set(words)) < 0.35 * n),
        (False, repeats(words) >= 4 and _longest_run(words) >= 5),
        (enough and ended > 0.6, enough and ended < 0.05),
    )
    return tuple(BAD if bad else GOOD if good else NONE for good, bad in said)


def _longest_run(words: list[str]) -> int:
    best = run = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        best = max(best, run)
    return best


def code_of(cast: tuple[int, ...]) -> int:
    """All votes as one number, one base-3 digit per labeller."""
    code = 0
    for v in cast:
        code = 3 * code + v
    return code


def votes_of(code: int) -> list[int]:
    return [code // 3**k % 3 for k in reversed(range(len(LABELLERS)))]


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good per pattern, vote rates [class, labeller, vote], share of good) from vote patterns and their counts.

    An abstention is a vote of its own: a labeller's silence tells the classes apart as well.
    """
    n, k = votes.shape
    prior = np.stack([np.tile(VOTE_PRIOR[y], (k, 1)) for y in (BAD, GOOD)])
    rates, share = prior / prior.sum(2, keepdims=True), np.array(CLASS_PRIOR) / sum(CLASS_PRIOR)
    post = np.full((n, 2), share)
    for _ in range(rounds):
        log = np.stack([np.log(rates[y][np.arange(k), votes]).sum(1) + np.log(share[y]) for y in (BAD, GOOD)], 1)
        new = np.exp(log - log.max(1, keepdims=True)) if n else log
        new = new / new.sum(1, keepdims=True) if n else new
        done = not n or float(np.abs(new - post).max()) < 1e-9
        post = new
        weight = count[:, None] * post
        for y in (BAD, GOOD):
            cast = np.stack([((votes == v) * weight[:, [y]]).sum(0) for v in (BAD, GOOD, NONE)], 1)
            rates[y] = (cast + prior[y]) / (cast + prior[y]).sum(1, keepdims=True)
        share = (weight.sum(0) + CLASS_PRIOR) / (count.sum() + sum(CLASS_PRIOR))
        if done:
            break
    return post[:, GOOD], rates, float(share[GOOD])


def accuracies(rates: np.ndarray) -> np.ndarray:
    """[class, labeller]: how often a vote is right, given the text's class and that there is a vote."""
    return np.stack([rates[y, :, y] / (rates[y, :, BAD] + rates[y, :, GOOD]) for y in (BAD, GOOD)])


def shape(word: str) -> str:
    """Runs of upper-case letters, other letters and digits as X, x and 0; runs of one sign as that sign."""
    out = ""
    for c in word:
        k = "X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c
        if not out.endswith(k):
            out += k
    return out


def features(word: str) -> tuple[int, int]:
    from zlib import crc32

    return crc32(b"s" + shape(word).encode()) % BUCKETS, crc32(b"e" + word[-2:].lower().encode()) % BUCKETS


def repeats(words: list[str]) -> int:
    """How often a word follows itself; the feature after the hashed ones."""
    return sum(map(eq, words, words[1:]))


class Remember(dict):
    """word -> make(word); bounded, emptied when full."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        out = self.make(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = out
        return out


@dataclass
class QualityModel:
    posterior: dict[int, float]  # by vote code
    accuracy: np.ndarray  # [class, labeller]
    share: float
    weights: np.ndarray
    bias: float

    def column(self, text: Column) -> Column:
        """Struct of votes (as one number), posterior and score."""
        posterior, weights, bias, share = self.posterior, self.weights, self.bias, self.share
        held: dict = {}

        def weigh(word: str) -> float:
            a, b = features(word)
            return float(weights[a] + weights[b])

        def run(text: pa.Array) -> pa.Array:
            table, kinds = held.setdefault("table", Remember(weigh)), held.setdefault("kinds", Remember(word_kind))
            codes, scores = [], []
            for t in text.to_pylist():
                w = (t or "").split()
                codes.append(code_of(votes(t or "", w, sum(map(kinds.__getitem__, w)))))
                z = bias + (sum(map(table.__getitem__, w)) + float(weights[-1]) * repeats(w)) / max(len(w), 1)
                scores.append(1 / (1 + math.exp(-min(max(z, -60), 60))) if w else 0.0)
            known = [posterior.get(c, share) for c in codes]
            return pa.StructArray.from_arrays([pa.array(codes, pa.int32()), pa.array(known, pa.float64()), pa.array(scores, pa.float64())], ["votes", "posterior", "score"])

        return F.arrow_udf(run, "struct<votes: int, posterior: double, score: double>")(text)


def _patterns(docs: DataFrame) -> list:
    """(code, count) of every vote pattern in the corpus; each task sends one row per pattern it met."""

    def run(batches):
        count, kinds = Counter(), Remember(word_kind)
        for b in batches:
            for t in b.column("text").to_pylist():
                w = (t or "").split()
                count[code_of(votes(t or "", w, sum(map(kinds.__getitem__, w))))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.int32()), pa.array(count.values(), pa.int64())], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()


def _sample(docs: DataFrame, rows: int) -> list:
    """(code, feature ids, feature shares) of at most rows distinct texts with words."""

    def run(batches):
        kinds, known = Remember(word_kind), Remember(features)
        for b in batches:
            codes, ids, shares = [], [], []
            for t in b.column("text").to_pylist():
                w = (t or "").split()
                if w:
                    f, n = np.unique(np.array([known[x] for x in w]), return_counts=True)
                    f, n = np.append(f, BUCKETS), np.append(n, repeats(w))
                    codes.append(code_of(votes(t, w, sum(map(kinds.__getitem__, w)))))
                    ids.append(f.astype("<i4").tobytes())
                    shares.append((n / len(w)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int32()), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], ["code", "ids", "shares"])

    some = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("text").alias("h"))
    cut = some.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h").alias("most"))
    chosen = some.join(F.broadcast(cut), F.col("h") <= F.col("most")).groupBy("h").agg(F.first("text").alias("text"))  # one row
    return chosen.orderBy("h").select("text").mapInArrow(run, "code int, ids binary, shares binary").collect()


def _logistic(ids: list[np.ndarray], shares: list[np.ndarray], y: np.ndarray, rounds: int = 150, rate: float = 0.5, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam over all rows."""
    w, m, v = (np.zeros(BUCKETS + 2) for _ in range(3))
    if not ids:
        return w[:-1], 0.0
    row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    col, x = np.concatenate(ids), np.concatenate(shares).astype(float)
    for k in range(1, rounds + 1):
        z = np.bincount(row, w[col] * x, len(ids)) + w[-1]
        err = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        g = np.append(np.bincount(col, err[row] * x, BUCKETS + 1), err.sum()) / len(ids)
        g[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel:
    patterns = _patterns(docs)
    cast = np.array([votes_of(p.code) for p in patterns], int).reshape(-1, len(LABELLERS))
    post, rates, share = expectation_maximisation(cast, np.array([p.n for p in patterns], float))
    posterior = {p.code: float(x) for p, x in zip(patterns, post, strict=True)}
    rows = _sample(docs, fit_rows)
    weights, bias = _logistic([np.frombuffer(r.ids, "<i4") for r in rows], [np.frombuffer(r.shares, "<f4") for r in rows], np.array([posterior[r.code] for r in rows]))
    return QualityModel(posterior, accuracies(rates), share, weights, bias)


def judge(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, votes, posterior, score and kept of every row."""
    scored = docs.select("doc_id", fit(docs, fit_rows).column(F.col("text")).alias("q"))
    return scored.select("doc_id", "q.votes", "q.posterior", "q.score", (F.col("q.score") >= THRESHOLD).alias("kept"))


def keep_good(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows that are kept, with all their columns."""
    return docs.where(fit(docs, fit_rows).column(docs["text"])["score"] >= THRESHOLD)
