"""Groups dealt to tasks: splitting of hot keys; whole groups as numpy slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sorted_groups import by_group

__all__ = ["by_group", "split_hot"]


def split_hot(rows: DataFrame, chunk: int, salt: str) -> DataFrame:
    """Adds columns i, j so that each (key, i, j) has at most about 2 * chunk rows and any two rows of a key meet.

    A key with more than chunk rows is dealt into chunks by a hash of salt; every row goes to the groups of
    its chunk with each chunk. Keys of one row are left out.
    """
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = rows.join(sizes, "key")
    n = F.ceil(F.col("size") / chunk).cast("int")
    mine = F.pmod(F.xxhash64(salt), n).cast("int")
    other = F.when(F.col("size") <= chunk, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1))
    dealt = met.withColumn("mine", F.when(F.col("size") <= chunk, 0).otherwise(mine)).withColumn("other", F.explode(other))
    return dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("size", "mine", "other")
