"""SimHash near-duplicates with bit-sliced comparison.

``link_documents``: all fingerprints within a radius, exactly. Fingerprints within r bits agree on at least
k of r + k equal blocks of bits, so every C(r + k, k) choice of blocks is a key and two linked fingerprints
share at least one. Groups of a key are compared through bit planes (``bitslice``) and yield a spanning
forest of their links; hot keys are dealt into pairs of chunks. Each distinct fingerprint takes part once.

``drop_linked``: of documents whose fingerprints are linked, one stays; the pipeline's near-duplicate stage.

``drop_near``: of documents whose shingle sets have a Jaccard similarity of at least 0.8, one stays. At that
similarity some 10 of 64 bits differ, which blocks of bits can't find; candidates share a pair of min-hashes of
the same shingles (8 pairs: a similarity of 0.8 is missed with probability 0.0003), and ``similar_sets`` verifies them.

Cases: null and empty texts, and texts without words, have fingerprint zero and are linked like any other in
``link_documents`` and ``drop_linked``; in ``drop_near`` texts without words are no duplicates of anything but each other.
Null doc_ids are no component's smallest id unless it has no other. Repeated rows are members like any
other. An empty table gives an empty result. Extra columns are ignored or carried.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitslice
from ..operators.components import stars as components
from .common import discard, materialize, without
from .groups import by_group, split_hot
from .similar_sets import Likeness, members, min_hash, shingle_hashes, stable

CHUNK = 2048  # rows of a key that are compared in one task
#: drop_near
WORDS, PERCENT, BANDS, PER_BAND = 5, 80, 8, 2
#: Share of all rows above which a fingerprint is settled map-side; bounds the broadcast to 1/SUPPORT rows.
SUPPORT = 0.001


def fingerprint(h: np.ndarray) -> int:
    """Bit b is 1 if set in over half the hashes."""
    if not len(h):
        return 0
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 4096):
        total += np.unpackbits(h[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for b in batches:
            fp = [fingerprint(shingle_hashes(t, words)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def extra_blocks(n: int, radius: int) -> int:
    """Blocks per key for n fingerprints: enough bits that a key holds a few of them, so pairs grow no faster than n."""
    return next(k for k in range(2, 64 - radius) if n <= 8 << (64 * k // (radius + k)) or k == 6)


def block_keys(fp: Column, radius: int, extra: int = 2) -> Column:
    """Array of keys: one per choice of extra blocks out of radius + extra; the choice is part of the key."""
    n = radius + extra
    edges = [64 * k // n for k in range(n + 1)]
    keys = []
    for c, chosen in enumerate(combinations(range(n), extra)):
        key = F.lit(c).cast("long")
        for k in chosen:
            width = edges[k + 1] - edges[k]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, edges[k]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def bucket_links(rows: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """Spanning links (a, b) between rows (key, id, fp) that share a key and differ in at most radius bits."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        a, b = bitslice.links(starts, table.column("id").to_numpy(), table.column("fp").to_numpy().view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return by_group(split_hot(rows, chunk, "id"), ["key", "i", "j"], run, "a long, b long")


def link_documents(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id reachable) of every row."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    extra = extra_blocks(distinct.count(), radius)
    keyed = distinct.select(F.explode(block_keys(F.col("fp"), radius, extra)).alias("key"), F.col("fp").alias("id"), "fp")
    stars = components(bucket_links(keyed, radius))
    linked = distinct.join(stars.withColumnRenamed("node", "fp"), "fp")
    lowest = linked.groupBy("root").agg(F.min("low").alias("lowest"))
    of_fp = distinct.join(linked.join(lowest, "root").select("fp", "lowest"), "fp", "left").select("fp", F.coalesce("lowest", "low").alias("component_id"))
    of_fp = materialize(of_fp, "component-ids")
    # rows of frequent fingerprints get their component map-side, the rest in a join
    names = materialize(rows.stat.freqItems(["fp"], SUPPORT).select(F.explode("fp_freqItems").alias("fp")), "frequent-fingerprints")
    heavy = of_fp.join(F.broadcast(names), "fp")
    light = rows.join(F.broadcast(names), "fp", "left_anti").join(of_fp, "fp")
    named = rows.join(F.broadcast(heavy), "fp").unionByName(light)
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_linked(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component of linked fingerprints the smallest doc_id."""
    key = "__near_row_id"
    tagged = stable(docs).withColumn(key, F.monotonically_increasing_id())
    ident = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(key).alias("id"))  # in the order in which rows stay
    linked = link_documents(tagged.select(ident.alias("doc_id"), "text"), words, radius)
    lost = materialize(linked.where(F.col("doc_id.id") != F.col("component_id.id")).select(F.col("doc_id.id").alias(key)), "near-lost")
    return without(tagged, lost, key).drop(key)


# documents that share most of their shingles

class MinHashPairs(Likeness):
    """Keys are BANDS groups of PER_BAND min-hashes each."""

    def signature(self, h: np.ndarray) -> list[int]:
        from xxhash import xxh64_intdigest

        lows = np.array([min_hash(h, k) for k in range(BANDS * PER_BAND)], np.uint64).reshape(BANDS, PER_BAND)
        return [xxh64_intdigest(lows[k].tobytes(), k) - (1 << 63) for k in range(BANDS)]

    def keys(self, signature: Column) -> Column:
        return signature


def drop_near(docs: DataFrame, like: Likeness = MinHashPairs(WORDS, PERCENT)) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of near-duplicates the smallest doc_id."""
    key = "__near_row_id"
    tagged = stable(docs).withColumn(key, F.monotonically_increasing_id())
    rows = members(tagged.select(F.col(key).alias("id"), "doc_id", "text"), like)
    stays = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")).alias("stay")).where("n > 1")
    lost = rows.join(stays, "root").where(F.col("id") != F.col("stay.id")).select(F.col("id").alias(key))
    lost = materialize(lost, "near-lost")
    discard(rows)
    return without(tagged, lost, key).drop(key)
