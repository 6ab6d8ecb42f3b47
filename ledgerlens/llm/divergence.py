"""Divergence of sources: how far apart the word use of a language's sources is, and what sets each source apart.

1. Each task counts its own documents' terms by (lang, source), so that one row a term, group and task is shuffled.
2. Terms in at least ``MIN_DOCUMENTS`` documents of a language are kept. They are dealt by ranges of (lang, term) into
   blocks; a term's id holds its block and its place there, so that ids sort like terms.
3. A group's counts within a block are one compressed vector (``pack``). While it is made, a heap ranks the terms
   that the group uses more than its language does.
4. Pairs meet as in a round-robin tournament by rotation: the groups of a (language, block) sit at stations of at most
   ``AT_STATION`` groups and stay there, and in every round each station meets one other. Of two stations that meet,
   one's vectors travel (``host`` says which); they pass the resident groups one by one, and a meeting counts for both
   directions. A task holds its residents' vectors and the travelling one.
5. Sums over blocks give the pairs' values; ranks are taken within a group.

Shares are exact whole numbers (``shares``), so no result depends on the partitioning. Every pair of groups is a
result row; no other step grows with their number squared. A hot group is as many entries as it has terms.

Cases: null text, lang and source read as ''. Texts without terms make a group all the same. A language without kept
terms gives pairs of value 0. Ties are ordered by the item's UTF-8 bytes. Repeated rows and ids count every time.
An empty table gives an empty result. Columns of other names are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_partitions
from .groups import by_group

MIN_DOCUMENTS, TOP = 10, 10
SCALE = 1_000_000_000
#: Terms of a block, about; entries that a task counts before it gives them away; groups at a station.
BLOCK_TERMS, HELD, AT_STATION = 1 << 15, 200_000, 8
#: Bytes as terms see them: ASCII letters in lower case and all other bytes from 0x80 stay, the rest separates.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, as UTF-8."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents) of every group; term is null in a row that stands for the group itself."""

    def run(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0

        def rows():
            keys = [(g, t) for g, (n, _) in groups.items() for t in n]
            out = [[g[0] for g, _ in keys], [g[1] for g, _ in keys], [None if t == b"" else t.decode() for _, t in keys]]
            counts = [[groups[g][k][t] for g, t in keys] for k in (0, 1)]
            groups.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in out), *(pa.array(x, pa.int64()) for x in counts)], ["lang", "source", "term", "n", "documents"])

        for b in batches:
            lang, source, text = (b.column(c) for c in ("lang", "source", "text"))
            for k in range(b.num_rows):
                n, documents = groups.setdefault((lang[k].as_py() or "", source[k].as_py() or ""), (Counter({b"": 0}), Counter()))
                words, before = terms_of(text[k].as_py()), len(n)
                n.update(words)
                documents.update(set(words))
                held += len(n) - before
                if held > HELD:
                    yield rows()
                    held = 0
        if groups:
            yield rows()

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, documents long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def keep_terms(counts: DataFrame, min_documents: int, block_terms: int) -> DataFrame:
    """(lang, term, id, lang_n) of the kept terms, written; id >> 33 is the block, and ids sort like (lang, term)."""
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("lang_n")).where(F.col("documents") >= min_documents).drop("documents")
    kept = materialize(kept, "kept-terms")
    dealt = kept.repartitionByRange(-(-max(1, kept.count()) // block_terms), "lang", "term").sortWithinPartitions("lang", "term")
    out = materialize(dealt.withColumn("id", F.monotonically_increasing_id()), "term-ids")
    discard(kept)
    return out


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total), exactly, for totals below 9e15; no count + 2 exceeds its total."""
    rest, out = counts + 2, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest %= total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are below 2^31."""
    return (p - q) ** 2 // (p + q)


def pack(places: np.ndarray, counts: np.ndarray) -> bytes:
    """A sparse vector: sorted places within the block as gaps, and counts, compressed."""
    kind = np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64
    gaps = np.diff(places, prepend=0).astype(np.uint32)
    head = np.array([len(places), np.dtype(kind).itemsize], np.int64)
    raw = head.tobytes() + gaps.tobytes() + counts.astype(kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(vector: bytes | None, size: int) -> np.ndarray:
    """The counts of all of a block's terms; no vector: none occurs."""
    out = np.zeros(size, np.int64)
    if vector is not None:
        raw = pa.decompress(vector[8:], int.from_bytes(vector[:8], "little"), "zstd", asbytes=True)
        n, width = np.frombuffer(raw, np.int64, 2).tolist()
        places = np.cumsum(np.frombuffer(raw, np.uint32, n, 16).astype(np.int64))
        out[places] = np.frombuffer(raw, np.uint32 if width == 4 else np.uint64, n, 16 + 4 * n)
    return out


def vectors(entries: DataFrame) -> DataFrame:
    """(lang, source, block, vector, top) of entries (lang, source, block, id, place, n, lang_n, total, lang_total); top: array of (value, id), best first."""

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        place, n, lang_n, ids, total, lang_total = (table.column(c).to_numpy() for c in ("place", "n", "lang_n", "id", "total", "lang_total"))
        packed, tops = [], []
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            packed.append(pack(place[lo:hi], n[lo:hi]))
            p, q = shares(n[lo:hi], total[lo]), shares(lang_n[lo:hi], lang_total[lo])
            more = np.flatnonzero(p > q)
            best = heapq.nsmallest(TOP, zip((-apart(p[more], q[more])).tolist(), ids[lo:hi][more].tolist(), strict=True))
            tops.append([{"value": -v, "id": i} for v, i in best])
        firsts = table.take(pa.array(starts[:-1]))
        return pa.RecordBatch.from_arrays(
            [*(firsts.column(c).combine_chunks() for c in ("lang", "source", "block")), pa.array(packed, pa.binary()), pa.array(tops, pa.list_(pa.struct([("value", pa.int64()), ("id", pa.int64())])))],
            ["lang", "source", "block", "vector", "top"],
        )

    return by_group(entries, ["lang", "source", "block"], run, "lang string, source string, block long, vector binary, top array<struct<value:long,id:long>>", order=("id",))


def partner(station: Column, round_: Column, stations: Column) -> Column:
    """Whom a station meets in a round (0, 1, ... one less than the even number of stations): an involution that pairs any two exactly once."""
    turning = stations - 1  # the last station stands still, the others turn
    met = F.pmod(round_ - station, turning)
    still = F.pmod(F.floor(F.when(round_ % 2 == 0, round_ / 2).otherwise((round_ + turning) / 2)), turning)
    return F.when(station == turning, still).when(met == station, turning).otherwise(met).cast("long")


def host(a: Column, b: Column) -> Column:
    """Of two stations that meet, the one whose groups stay; every station is host about as often as guest."""
    return F.when((a + b) % 2 == 0, F.least(a, b)).otherwise(F.greatest(a, b))


def meetings(groups: DataFrame) -> DataFrame:
    """groups (lang, block, source, station, stations, ...) once resident at its station (round -1) and once for every station that it travels to, in the order of rounds."""
    rounds = F.col("stations") + F.col("stations") % 2 - 1
    resident = groups.withColumn("round", F.lit(-1).cast("long")).withColumn("at", F.col("station"))
    turns = groups.where("stations > 1").withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), rounds - 1)))
    met = turns.withColumn("met", partner(F.col("station"), F.col("round"), rounds + 1)).where("met < stations")  # an odd number: one rests
    travels = met.withColumn("at", host(F.col("station"), F.col("met"))).where("at = met").drop("met")
    return resident.unionByName(travels)


def compare(cells: DataFrame) -> DataFrame:
    """(lang, a, b, value) of the pairs that meet in cells (lang, block, at, round, source, size, total, vector); of a block's terms only."""

    def run(batches):
        here, residents, shares_here = None, [], []
        for batch in batches:
            out = []
            named = batch.select(["lang", "block", "at", "round", "source", "size", "total"]).to_pylist()
            for k, row in enumerate(named):
                cell = (row["lang"], row["block"], row["at"])
                if cell != here:
                    here, residents, shares_here = cell, [], []
                p = shares(unpack(batch.column("vector")[k].as_py(), row["size"]), row["total"])
                out += [(row["lang"], *sorted((source, row["source"])), int(apart(p, q).sum())) for source, q in zip(residents, shares_here, strict=True)]
                if row["round"] < 0:
                    residents.append(row["source"])
                    shares_here.append(p)
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], ["lang", "a", "b", "value"])

    dealt = cells.repartition(shuffle_partitions(cells.sparkSession), "lang", "block", "at").sortWithinPartitions("lang", "block", "at", "round", "source")
    return dealt.mapInArrow(run, "lang string, a string, b string, value long")


def ranked(rows: DataFrame) -> DataFrame:
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(best))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, block_terms: int = BLOCK_TERMS, at_station: int = AT_STATION) -> DataFrame:
    """lang, source, part, item, value, rank: of every (lang, source) its distance to the language's other sources, and the terms that set it apart."""
    counts = materialize(count_terms(docs), "term-counts")
    terms = keep_terms(counts, min_documents, block_terms)
    block = F.shiftright("id", 33).alias("block")
    blocks = terms.groupBy("lang", block).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"), F.sum("lang_n").alias("n"))
    blocks = materialize(blocks, "term-blocks")
    langs = blocks.groupBy("lang").agg((F.sum("n") + 2 * F.sum("size")).alias("lang_total"), F.sum("size").alias("kept"))
    used = materialize(counts.join(terms, ["lang", "term"]).select("lang", "source", "id", "n", "lang_n"), "term-entries")

    order = Window.partitionBy("lang").orderBy("source")
    every = Window.partitionBy("lang")
    groups = counts.where("term IS NULL").select("lang", "source").join(used.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select(
        *("lang", "source", "lang_total"),
        (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("kept", F.lit(0))).alias("total"),
        F.floor((F.row_number().over(order) - 1) / at_station).alias("station"),
        F.ceil(F.count(F.lit(1)).over(every) / at_station).alias("stations"),
    )
    groups = materialize(groups, "term-groups")

    entries = used.withColumn("block", block).join(blocks.select("lang", "block", "first"), ["lang", "block"]).withColumn("place", F.col("id") - F.col("first"))
    made = materialize(vectors(entries.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])), "term-vectors")

    # every group meets the others in every block of its language, whether it has terms there or not
    cells = groups.join(blocks.select("lang", "block", "size"), "lang", "left").join(made.select("lang", "source", "block", "vector"), ["lang", "source", "block"], "left")
    cells = cells.select("lang", F.coalesce("block", F.lit(-1)).alias("block"), "source", "station", "stations", "total", F.coalesce("size", F.lit(0)).alias("size"), "vector")
    pairs = materialize(compare(meetings(cells)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "term-pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    tops = made.select("lang", "source", F.explode("top").alias("t")).select("lang", "source", "t.value", "t.id")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "id")
    tops = tops.withColumn("place", F.row_number().over(first)).where(F.col("place") <= TOP).drop("place")
    named = materialize(tops.join(terms.select("lang", "id", F.col("term").alias("item")), ["lang", "id"]).select("lang", "source", "item", "value"), "top-terms")
    discard(counts, terms, blocks, used, groups, made)
    out = ranked(both).withColumn("part", F.lit("pair")).unionByName(ranked(named).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
