"""Groups of texts whose shingle sets are similar: verified links between candidates, and their components.

A ``Likeness`` says how many words a shingle has, which similarity links two sets, and which keys a set has; two
rows that share a key are candidates. Equal sets are settled by their digest, and only one row of each takes part.
Every row is first held against its key's smallest id only, so that a group of near copies costs one comparison a
row; whole texts are compared pair by pair of (row, smallest id). Keys whose rows are then one component are done. In
the others, rows of different components that may be similar are compared too, the first few of each row and then
more and more, until none is left: no candidate's link is lost and no group's pairs are listed. A large key is cut by set
sizes first, since sets of one part in PERCENT are about as large. Left out are only pairs that can't be similar: odd
sketches (bit b is the parity of the distinct shingles whose hash is b modulo SKETCH) differ in no more bits than the
sets in shingles. On sets of over 2000 shingles that leaves few out, so long texts cost more there, but none is lost.
Sets are of 64-bit hashes of the shingles.

Cases: texts without words have the empty set, and are alike only to each other, by their digest. An empty table gives
no links.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import stars as components
from .common import discard, materialize, small
from .groups import by_group

SEED, SKETCH = 42, 1024
CHECKED = 192  # texts that are held against one text in one task
COMPARED = 2048  # rows of a key whose sketches are compared in one task, at least
PARTNERS = 2  # candidates of a row that are checked at first; MORE times as many in every further round, of what is still apart
MORE = 16


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every run of words, repeats included; of the whole sequence where it is shorter."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) <= words:
        return np.array([xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = [0, *(ends[: -words] + 1).tolist()]
    return np.array([xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def odd_sketch(distinct: np.ndarray) -> bytes:
    """SKETCH bits: the parity of the number of hashes at each place."""
    at = np.bincount((distinct % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    return np.packbits(at & 1 == 1, bitorder="little").tobytes()


_MULTIPLIERS = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ (k * 0xD1B54A32D192ED03)) & 0xFFFFFFFFFFFFFFFF | 1 for k in range(1, 65)], np.uint64)


def min_hash(h: np.ndarray, k: int) -> np.uint64:
    """The smallest of the hashes after the k-th mixing (k below 32)."""
    x = h * _MULTIPLIERS[k]
    x ^= x >> np.uint64(29)
    return (x * _MULTIPLIERS[-1 - k]).min()


@dataclass(frozen=True)
class Likeness:
    """Sets of shingles of so many words are alike from so many per cent of their union on."""

    words: int
    percent: int

    def signature(self, h: np.ndarray) -> list[int]:
        """What keys and ``close`` are made of, as signed longs; h isn't empty."""
        raise NotImplementedError

    def keys(self, signature: Column) -> Column:
        """Array of the keys under which a row meets others."""
        raise NotImplementedError

    def close_rows(self, a: Column, b: Column) -> Column:
        """Whether rows of these signatures are candidates, beside sharing a key."""
        return F.lit(True)

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The same for a matrix of signatures a and one signature b."""
        return np.ones(len(a), bool)

    def shingles(self, text: str | None) -> np.ndarray:
        return np.unique(shingle_hashes(text, self.words))

    def are_similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Of two sorted sets, counted exactly."""
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    def may_be_similar(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether sets of these sketches and together these sizes can be alike; false only if they can't."""
        differ = np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)
        return (100 + self.percent) * differ <= (100 - self.percent) * sizes

    def may_be_similar_rows(self, a: str, b: str) -> Column:
        """The same on columns a.sketch, a.size, b.sketch, b.size."""
        differ = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        return (100 + self.percent) * differ <= (100 - self.percent) * (F.col(f"{a}.size") + F.col(f"{b}.size"))

    def size_class(self, size: Column) -> Column:
        """Similar sets are in one class or in neighbouring ones."""
        return F.floor(F.log(size) / (math.log(100 / self.percent) * (1 + 1e-9)))


def describe(tagged: DataFrame, like: Likeness) -> DataFrame:
    """id, doc_id, size (distinct shingles), sketch, digest of the set, signature (null without words) of every row (id, doc_id, text)."""
    from xxhash import xxh3_128_digest

    def run(batches):
        for b in batches:
            sizes, sketches, digests, signatures = [], [], [], []
            for t in b.column("text"):
                h = like.shingles(t.as_py())
                sizes.append(len(h))
                sketches.append(np.frombuffer(odd_sketch(h), np.int64))
                digests.append(xxh3_128_digest(h.tobytes()))
                signatures.append(like.signature(h) if len(h) else None)
            longs = pa.list_(pa.int64())
            columns = [b.column("id"), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sketches, longs), pa.array(digests, pa.binary()), pa.array(signatures, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "doc_id", "size", "sketch", "digest", "signature"])

    kind = tagged.schema["doc_id"].dataType.simpleString()
    return tagged.select("id", "doc_id", "text").mapInArrow(run, f"id long, doc_id {kind}, size long, sketch array<long>, digest binary, signature array<long>")


def similar_pairs(tagged: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """Those of pairs (a, b), a written table, whose texts are alike, written; each b's text meets its a's in groups of CHECKED."""
    chunks = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CHECKED).cast("int").alias("chunks"))
    members = pairs.join(chunks, "b").select(F.col("a").alias("id"), "b", F.pmod(F.xxhash64("a"), "chunks").cast("int").alias("chunk"), F.lit(True).alias("other"))
    ones = chunks.select(F.col("b").alias("id"), "b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("other"))
    needed = materialize(members.unionByName(ones), "near-needed")
    rows = tagged.select("id", "text").join(small(needed), "id")

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        out, ids, text = [], table.column("id").to_pylist(), table.column("text")
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            first, *rest = (like.shingles(t.as_py()) for t in text.slice(lo, hi - lo))
            out += [(ids[lo + k], ids[lo]) for k, h in enumerate(rest, 1) if like.are_similar(h, first)]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    out = materialize(by_group(rows, ["b", "chunk"], run, "a long, b long", rows_at_once=256, order=("other",)), "near-links")
    discard(needed)
    return out


def deal_labelled(rows: DataFrame, chunk: int, like: Likeness) -> DataFrame:
    """Rows (key, id, label, size, ...) of keys with several labels, with columns cut, i, j: any two rows of a key with different labels that can be similar meet in one (key, cut, i, j).

    A key of over chunk rows is cut by size classes, each row in its own and the next one. What still has more is dealt:
    the rows of its most frequent label into chunks, each with all others, or, where those are more than chunk
    too, all rows into pairs of chunks.
    """
    per = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    keys = per.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("key", "n")
    c = like.size_class(F.col("size"))
    cut = F.explode(F.when(F.col("n") <= chunk, F.array(F.lit(-1).cast("long"))).otherwise(F.array(c, c + 1))).alias("cut")
    cuts = rows.join(keys, "key").select(*rows.columns, cut)
    per = cuts.groupBy("key", "cut", "label").agg(F.count(F.lit(1)).alias("n"))
    parts = per.groupBy("key", "cut").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    met = cuts.join(parts, ["key", "cut"])
    few = F.col("n") - F.col("top.n") <= chunk
    dealt = F.ceil(F.when(few, F.col("top.n")).otherwise(F.col("n")) / chunk).cast("int")
    mine = F.pmod(F.xxhash64("id"), dealt).cast("int")
    every = F.sequence(F.lit(0), dealt - 1)
    is_top = F.col("label") == F.col("top.label")
    places = (
        F.when(F.col("n") <= chunk, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))))
        .when(few & is_top, F.array(F.struct(mine.alias("i"), mine.alias("j"))))
        .when(few, F.transform(every, lambda k: F.struct(k.alias("i"), k.alias("j"))))
        .otherwise(F.transform(every, lambda k: F.struct(F.least(k, mine).alias("i"), F.greatest(k, mine).alias("j"))))
    )
    return met.withColumn("at", F.explode(places)).select(*rows.columns, "cut", "at.i", "at.j")


def partners(rows: DataFrame, sets: DataFrame, most: int, like: Likeness, chunk: int) -> DataFrame:
    """(a, b) of rows (key, id, label, size) with sets (id, sketch, signature): for every row the first candidates of smaller id with another label, at most most of them for each key; a row of nulls where there are more."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, size, label = (table.column(c).to_numpy() for c in ("id", "size", "label"))
        sketch, signature = (table.column(c).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1) for c in ("sketch", "signature"))
        a, b = [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            for q in range(lo + 1, hi):
                rest = lo + np.flatnonzero(label[lo:q] != label[q])
                rest = rest[like.close(signature[rest], signature[q])]
                near = rest[like.may_be_similar(sketch[rest], sketch[q], size[rest] + size[q])]
                a += [ids[q]] * min(len(near), most)
                b += ids[near[:most]].tolist()
                if len(near) > most:
                    a.append(None)
                    b.append(None)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = deal_labelled(rows, chunk, like).join(sets.select("id", "sketch", "signature"), "id")
    return by_group(dealt, ["key", "cut", "i", "j"], run, "a long, b long", rows_at_once=1 << 13, order=("id",)).distinct()


def linked(tagged: DataFrame, described: DataFrame, like: Likeness) -> DataFrame:
    """(digest, root) of every distinct set of described (a written table), written; root is the smallest id reachable over sets that are alike. tagged (id, text) must be stable."""
    sets = materialize(described.groupBy("digest").agg(F.min(F.struct("id", "size", "sketch", "signature")).alias("r")).select("digest", "r.*"), "near-sets")
    each = sets.where("size > 0").select(F.explode(like.keys(F.col("signature"))).alias("key"), "id", "size")  # ids travel alone, sketches join the pairs
    firsts = each.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = materialize(each.join(firsts, "key"), "near-rows")
    met = rows.where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    x, y = (sets.select(F.col("id").alias(c), F.struct("size", "sketch", "signature").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    may = like.close_rows(F.col("x.signature"), F.col("y.signature")) & like.may_be_similar_rows("x", "y")
    tested = [materialize(met.join(x, "a").join(y, "b").where(may).select("a", "b"), "near-pairs")]
    links = similar_pairs(tagged, tested[0], like)
    labels = components(links, "near-components")
    discard(links)
    most = PARTNERS
    while True:
        labelled = rows.join(labels, rows["id"] == labels["node"], "left").select("key", "id", "size", F.coalesce("root", "id").alias("label"))
        found = materialize(partners(labelled, sets, most, like, COMPARED), "near-partners")
        n, more = found.agg(F.count("a"), F.count_if(F.col("a").isNull())).first()
        if n:
            fresh = found.where("a IS NOT NULL")
            for t in tested:
                fresh = fresh.join(t, ["a", "b"], "left_anti")
            tested.append(materialize(fresh, "near-pairs"))
            similar = similar_pairs(tagged, tested[-1], like)
            if not similar.isEmpty():  # labels and new links hold all links so far
                known = labels.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
                old, labels = labels, components(known.unionByName(similar), "near-components")
                discard(old)
            discard(similar)
        discard(found)
        if not more:
            break
        most *= MORE
    out = materialize(sets.join(labels, sets["id"] == labels["node"], "left").select("digest", F.coalesce("root", "id").alias("root")), "near-roots")
    discard(sets, rows, labels, *tested)
    return out


def stable(docs: DataFrame) -> DataFrame:
    """docs where it is a plain scan of files, whose row ids come out alike in every run; else written once."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    return docs if plan.nodeName().startswith("LogicalRelation") or plan.nodeName().startswith("Relation") else materialize(docs, "near-input")


def members(tagged: DataFrame, like: Likeness) -> DataFrame:
    """id, doc_id, size and root (the smallest id of the row's group) of every row of tagged (id, doc_id, text), which must be stable; written."""
    described = materialize(describe(tagged, like), "near-keys")
    roots = linked(tagged, described, like)
    out = materialize(described.join(roots, "digest").select("id", "doc_id", "size", "root"), "near-members")
    discard(described, roots)
    return out
