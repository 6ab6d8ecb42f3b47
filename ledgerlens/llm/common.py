"""Shared helpers: reading tables, word characters, removal of lost rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, new_path, shuffle_partitions, spread

__all__ = ["SPACE", "WORD", "discard", "materialize", "new_path", "read_table", "shuffle_partitions", "small", "spread", "without"]

#: Word characters of all text operators: anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Lost ids up to this count (8 MB of them) are broadcast; more are matched by a shuffle.
BROADCAST_IDS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(ids: DataFrame) -> DataFrame:
    """ids, a written table, marked for broadcast where it is proven to have at most BROADCAST_IDS rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def without(rows: DataFrame, lost: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't in lost (a written table): texts stay where they are unless very many rows are lost."""
    return rows.join(small(lost), key, "left_anti")
