"""URL filter: allow and block rules first, gradient-boosted trees on lexical features for the rest.

The urls that a rule decides are the labelled ones. The trees are fitted on the driver on at most FIT_ROWS
distinct labelled urls (those with the smallest hashes, so the choice doesn't depend on order or
partitioning) and compiled into one Column expression; every url is scored inside the JVM. The suffix
statistics come from all labelled urls and are joined by suffix; the fitted rows see those of the other FOLDS
only (leaving out single labels would tell the label by the difference). ``held_out_accuracy`` fits on four fifths of the labelled urls and judges the last one.

Cases: a null url, or one without ``://``, has an empty host and path; no rule fits it and the trees judge
its characters. Repeated urls get equal rows. Without labelled urls of both classes the trees are constant
and allow everything. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (host, path, verdict); the longest rule that fits wins.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
FIT_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAF = 20, 3, 0.3, 32, 20
SMOOTHING = 20.0
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("f_length", "f_host_length", "f_depth", "f_path_length", "f_digit_ratio", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_https", "f_suffix1", "f_suffix2")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path of a url; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule, like ``net/``, and its verdict; both null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _count(s: Column, chars: str) -> Column:
    return (F.length(s) - F.length(F.translate(s, chars, ""))).cast("double")


def _entropy(s: Column) -> Column:
    """Shannon entropy of the characters, in bits: each distinct character's count comes from one sorted pass."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.length(s).cast("double")
    counts = F.transform(F.array_distinct(chars), lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("double") / n)
    return F.coalesce(F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)), F.lit(0.0))


def with_lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and the host's last one and two labels to columns url, host, path."""
    u = F.coalesce(F.col("url"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    length = F.length(u).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return urls.select(
        "*",
        length.alias("f_length"),
        F.length(host).cast("double").alias("f_host_length"),
        _count(path, "/").alias("f_depth"),
        F.length(path).cast("double").alias("f_path_length"),
        (_count(u, "0123456789") / F.greatest(length, F.lit(1.0))).alias("f_digit_ratio"),
        _entropy(u).alias("f_entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1).alias("f_params"),
        _count(host, ".").alias("f_labels"),
        _count(host, "-").alias("f_hyphens"),
        u.startswith("https://").cast("double").alias("f_https"),
        F.substring_index(host, ".", -1).alias("suffix1"),
        F.substring_index(host, ".", -2).alias("suffix2"),
    )


@dataclass(frozen=True)
class UrlModel:
    base: float
    trees: tuple  # nested (feature, threshold, left, right) or a leaf value
    suffixes: DataFrame  # suffix, rate, of all labelled urls
    prior: float

    def score(self) -> Column:
        """Probability of block, as an expression on the FEATURES columns."""
        z = " + ".join([repr(self.base), *(_sql(t) for t in self.trees)])
        return F.expr(f"1D / (1D + exp(-({z})))")


def _sql(node) -> str:
    if not isinstance(node, tuple):
        return f"{node!r}D"
    f, t, left, right = node
    return f"CASE WHEN {FEATURES[f]} <= {t!r}D THEN {_sql(left)} ELSE {_sql(right)} END"


def _grow(x: np.ndarray, bins: list[np.ndarray], binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int):
    leaf = float(round(RATE * grad[rows].sum() / (hess[rows].sum() + 1.0), 12))
    if depth == 0 or len(rows) < 2 * LEAF:
        return leaf
    g_all, h_all, best = grad[rows].sum(), hess[rows].sum(), (1e-6, None)
    for f, edges in enumerate(bins):
        if not len(edges):
            continue
        b = binned[rows, f]
        g, h, n = (np.cumsum(np.bincount(b, w, len(edges) + 1))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
        gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
        gain[(n < LEAF) | (len(rows) - n < LEAF)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], (f, k))
    if best[1] is None:
        return leaf
    f, k = best[1]
    left = binned[rows, f] <= k
    return (f, float(bins[f][k]), *(_grow(x, bins, binned, grad, hess, r, depth - 1) for r in (rows[left], rows[~left])))


def _walk(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    f, t, left, right = node
    return np.where(x[:, f] <= t, _walk(left, x), _walk(right, x))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple]:
    """Gradient-boosted trees for the logistic loss, on binned features."""
    if not len(y) or y.min() == y.max():
        return (-4.0 if not len(y) or y[0] == 0 else 4.0), ()
    base = float(np.log(y.mean() / (1 - y.mean())))
    bins = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(bins, x.T, strict=True)], 1)
    z, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        t = _grow(x, bins, binned, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
        z += _walk(t, x)
        trees.append(t)
    return base, tuple(trees)


def fold(url: str = "url") -> Column:
    return F.pmod(F.xxhash64(url), F.lit(FOLDS)).cast("int")


def with_suffix_rates(urls: DataFrame, suffixes: DataFrame, prior: float, folds: DataFrame | None = None) -> DataFrame:
    """Adds the smoothed share of blocked urls of both suffixes; with folds (suffix, fold, blocked, n), without the url's own fold."""
    out = urls.withColumn("__fold", fold())
    for k in ("1", "2"):
        counts = suffixes.select(F.col("suffix").alias(f"suffix{k}"), F.col("blocked").alias("__b"), F.col("n").alias("__n"))
        out = out.join(counts, f"suffix{k}", "left")
        b, n = F.col("__b"), F.col("__n")
        if folds is not None:
            own = folds.select(F.col("suffix").alias(f"suffix{k}"), F.col("fold").alias("__fold"), F.col("blocked").alias("__fb"), F.col("n").alias("__fn"))
            out = out.join(own, [f"suffix{k}", "__fold"], "left")
            b, n = b - F.coalesce("__fb", F.lit(0.0)), n - F.coalesce("__fn", F.lit(0))
        rate = (b + SMOOTHING * prior) / (n + SMOOTHING)
        out = out.withColumn(f"f_suffix{k}", F.coalesce(rate, F.lit(prior))).drop("__b", "__n", "__fb", "__fn")
    return out.drop("__fold")


def fit(urls: DataFrame, fit_rows: int = FIT_ROWS) -> UrlModel:
    """Fit on urls (url, host, path, verdict of the rule or null), from those with a verdict."""
    labelled = urls.where(F.col("verdict").isNotNull()).select("url", "host", "path", (F.col("verdict") == "block").cast("double").alias("y")).distinct()
    prior = labelled.agg(F.avg("y")).first()[0]
    prior = 0.0 if prior is None else float(prior)
    pairs = with_lexical(labelled).select(F.explode(F.array_distinct(F.array("suffix1", "suffix2"))).alias("suffix"), fold().alias("fold"), "y")
    folds = materialize(pairs.groupBy("suffix", "fold").agg(F.sum("y").alias("blocked"), F.count("y").alias("n")), "url-folds")
    sums = folds.groupBy("suffix").agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n"))
    suffixes = materialize(sums.withColumn("rate", (F.col("blocked") + SMOOTHING * prior) / (F.col("n") + SMOOTHING)), "url-suffixes")
    sample = materialize(with_lexical(labelled.orderBy(F.xxhash64("url"), "url").limit(fit_rows)), "url-sample")
    rows = with_suffix_rates(sample, suffixes, prior, folds).orderBy("url").select(*FEATURES, "y").collect()
    data = np.array([tuple(r) for r in rows], dtype=float).reshape(-1, len(FEATURES) + 1)
    base, trees = boost(data[:, :-1], data[:, -1])
    return UrlModel(base, trees, suffixes, prior)


def _ruled(pages: DataFrame, rules) -> DataFrame:
    host, path = host_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return split.select("*", rule.alias("rule"), verdict.alias("verdict"))


def held_out_accuracy(pages: DataFrame, rules=RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row: urls judged, share judged as their rule says, share of the more frequent verdict among them."""
    known = _ruled(pages, rules).where("verdict IS NOT NULL")
    last = F.pmod(F.xxhash64("url", "host"), F.lit(5)) == 0
    model = fit(known.where(~last), fit_rows)
    judged = with_suffix_rates(with_lexical(known.where(last)), model.suffixes, model.prior).select((F.col("verdict") == "block").alias("y"), (model.score() >= 0.5).alias("said"))
    return judged.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("said")).cast("double")).alias("accuracy"), F.greatest(F.avg(F.col("y").cast("double")), 1 - F.avg(F.col("y").cast("double"))).alias("majority"))


def judge(pages: DataFrame, rules=RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score for every row."""
    ruled = _ruled(pages, rules)
    model = fit(ruled, fit_rows)
    scored = with_suffix_rates(with_lexical(ruled), model.suffixes, model.prior).withColumn("score", model.score())
    by_trees = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_trees).alias("verdict"), "score")
