"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

1. Every text's SHA-256 digest goes to a small written table with the row's id.
2. A Misra-Gries summary (Karp-Schenker-Papadimitriou form, ``stat.freqItems``) names every digest that
   holds more than ``support`` of the rows, and possibly a few others. It has at most 1/support entries.
3. Their exact sizes and winners are counted; those verified winners, at most 1/support rows, are
   broadcast, so the rows of the hottest texts are settled map-side and never shuffled.
4. All other digests, none of them with more than ``support`` of the rows, meet in an ordinary shuffle.

Cases: a null text counts as empty. A null doc_id is smaller than any other. Rows that repeat one doc_id
with one text are members like any other; exactly one row of a group is kept. An empty table gives an
empty result. Other columns are ignored by ``mark_exact`` and carried by ``drop_exact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, without

#: Share of all rows above which a digest is settled map-side; bounds the broadcast to 1/SUPPORT rows.
SUPPORT = 0.001


def digest(text: Column | str = "text") -> Column:
    """SHA-256 of the UTF-8 text as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256))


def heavy_winners(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(sha, win, group_size) of the digests that hold more than support of the rows; at most 1/support rows."""
    # as hex: the summary compares binary values by identity
    hexed = rows.select(F.hex("sha").alias("h"))
    names = hexed.stat.freqItems(["h"], support).select(F.explode("h_freqItems").alias("h")).select(F.unhex("h").alias("sha"))
    names = materialize(names, "frequent")
    counted = rows.join(F.broadcast(names), "sha").groupBy("sha").agg(*_winner())
    total = rows.agg(F.count(F.lit(1)).alias("n_rows"))
    verified = counted.join(F.broadcast(total), F.col("group_size") > support * F.col("n_rows")).drop("n_rows")
    return materialize(verified, "winners")


def _winner() -> tuple[Column, Column]:
    return F.max(F.struct("doc_id", "row_id")).alias("win"), F.count(F.lit(1)).alias("group_size")


def resolve(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """rows (doc_id, row_id, sha) with win and group_size added. rows must be stable: a written table."""
    heavy = heavy_winners(rows, support)
    light = rows.join(F.broadcast(heavy.select("sha")), "sha", "left_anti")
    settled = light.join(light.groupBy("sha").agg(*_winner()), "sha")
    return rows.join(F.broadcast(heavy), "sha").unionByName(settled)


def mark_exact(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialize(docs.select("doc_id", F.monotonically_increasing_id().alias("row_id"), digest().alias("sha")), "digests")
    return resolve(rows, support).select(
        "doc_id",
        F.col("win.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("win.row_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of docs that stay, with all their columns. docs must be a stable scan (a table), for its row ids."""
    key = "__exact_row_id"
    tagged = docs.withColumn(key, F.monotonically_increasing_id())
    rows = materialize(tagged.select("doc_id", F.col(key).alias("row_id"), digest().alias("sha")), "digests")
    lost = resolve(rows, support).where(F.col("row_id") != F.col("win.row_id")).select(F.col("row_id").alias(key))
    return without(tagged, materialize(lost, "exact-lost"), key).drop(key)
