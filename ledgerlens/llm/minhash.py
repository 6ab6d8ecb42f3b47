"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

A signature holds BITS bits of each of LANES min-hashes of a document's distinct shingles; two documents of
similarity s differ in a lane with probability 1 - s. The signature is split into chunks of PER_CHUNK lanes. By
pigeonhole, two signatures that differ in at most RADIUS = chunks * (ERRORS + 1) - 1 lanes have a chunk with at most
ERRORS of them, so each chunk gives one key for every choice of ERRORS lanes that may be wrong, made of its other
lanes: all pairs within RADIUS share a key, however many documents there are. Signatures of documents
of similarity 0.85 are further apart with probability 0.000003 (of 0.9: 0.00000001), since they differ in 4.8 of 32
lanes on average. A key has 48 bits, so unrelated documents meet in none. Pairs that meet and are within RADIUS are
confirmed on the full sets by ``similar_sets``, which lists no group's pairs.

Cases: null and empty texts, and texts without words, have no shingles and are linked with nothing, each other
included. Null doc_ids are no component's smallest id unless it has no other; a null id is kept where its component's
is null too. Repeated rows are members like any other, and rows that share the smallest id are all kept. An empty
table gives an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similar_sets import Likeness, members, min_hash, stable

WORDS, PERCENT = 3, 85
#: A chunk's lanes fill a long.
BITS, LANES, PER_CHUNK, ERRORS = 16, 32, 4, 1
CHUNKS = LANES // PER_CHUNK
RADIUS = CHUNKS * (ERRORS + 1) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _lane(k: int) -> int:
    return ((1 << BITS) - 1) << BITS * k


class LaneSignatures(Likeness):
    def signature(self, h: np.ndarray) -> list[int]:
        """One long per chunk."""
        return np.array([int(min_hash(h, k)) & _lane(0) for k in range(LANES)], np.uint16).view(np.int64).tolist()

    def keys(self, signature: Column) -> Column:
        """Per chunk and choice of ERRORS lanes: the chunk without them; their place holds the choice's number."""
        keys = []
        for c in range(CHUNKS):
            for n, wrong in enumerate(combinations(range(PER_CHUNK), ERRORS)):
                rest = ~sum(map(_lane, wrong)) & ((1 << 64) - 1)
                tag = (c * PER_CHUNK**ERRORS + n) << BITS * wrong[0]
                keys.append(signature[c].bitwiseAND(F.lit(_signed(rest))).bitwiseOR(F.lit(_signed(tag))))
        return F.array(*keys)

    def close_rows(self, a: Column, b: Column) -> Column:
        differ = F.lit(0)
        for c in range(CHUNKS):
            x = a[c].bitwiseXOR(b[c])
            for k in range(PER_CHUNK):
                differ += F.when(x.bitwiseAND(F.lit(_signed(_lane(k)))) != 0, 1).otherwise(0)
        return differ <= RADIUS

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a ^ b).view(np.uint16).reshape(len(a), LANES) != 0).sum(1) <= RADIUS


def link_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id is component_id) of every row."""
    tagged = stable(docs.select("doc_id", "text")).withColumn("id", F.monotonically_increasing_id())
    rows = members(tagged, LaneSignatures(words, percent))
    lowest = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")).where("n > 1")
    named = rows.join(lowest, "root", "left")
    component = F.when((F.col("size") > 0) & F.col("n").isNotNull(), F.col("low")).otherwise(F.col("doc_id")).alias("component_id")
    return named.select("doc_id", F.col("size").alias("n_shingles"), component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
