"""Read-side aggregates: profiles, histograms, previews, medians, ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .amounts import money


def profile(rows: DataFrame, key: str, amount: str, flag: Column, at: str) -> DataFrame:
    """Per key: rows, total, share of everything, rows with a known flag, flagged rows and their share, first and last date."""
    by_key = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(money(amount)).alias("sum"),
        F.count(flag).alias("n_known"),
        F.count_if(flag).alias("n_flagged"),
        F.date_format(F.min(at), "yyyy-MM-dd").alias("first_date"),
        F.date_format(F.max(at), "yyyy-MM-dd").alias("last_date"),
    )
    everything = by_key.agg(F.sum("sum").alias("all"))
    return by_key.join(F.broadcast(everything)).select(  # one row
        key,
        "n",
        F.col("sum").cast("double").alias("total"),
        F.try_divide(F.col("sum").cast("double"), F.col("all").cast("double")).alias("share"),
        "n_known",
        "n_flagged",
        F.try_divide(F.col("n_flagged").cast("double"), F.col("n_known").cast("double")).alias("flagged_share"),
        "first_date",
        "last_date",
    )


def histogram(rows: DataFrame, *dimensions: tuple[str, DataFrame]) -> DataFrame:
    """Counts per combination of the given literal dimensions, zeros included."""
    grid = None
    for name, values in dimensions:
        one = F.broadcast(values.select(name))  # literal values
        grid = values.select(name) if grid is None else grid.join(one)
    keys = [n for n, _ in dimensions]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def peer_median(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Every row's value beside the exact median of its group."""
    medians = rows.groupBy(group).agg(F.median(value).alias("peer_median"), F.count(value).alias("n_peers"))
    return rows.select(group, key, value).join(medians, group).withColumn("above", F.col(value) > F.col("peer_median"))


def one_per_group_then_fill(rows: DataFrame, group: str, order: Sequence[Column], limit: int) -> DataFrame:
    """Up to limit rows: each group's best first, the best of the rest after them."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("is_first", best == 1).orderBy(F.desc("is_first"), *order).limit(limit)


def worst(rows: DataFrame, keys: Sequence[str], status: str, ranks: dict[str, int]) -> DataFrame:
    """The status of the highest rank per key; unknown statuses rank lowest."""
    rank = F.coalesce(*[F.when(F.col(status) == s, r) for s, r in ranks.items()], F.lit(-1))
    return rows.groupBy(*keys).agg(F.max_by(status, F.struct(rank, F.col(status))).alias(status))


def assignment_totals(rows: DataFrame, label: Column, amount: str) -> DataFrame:
    """Totals by label with everything unlabelled in one bucket, so that parts add up to the whole."""
    return rows.groupBy(F.coalesce(label, F.lit("(unassigned)")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(money(amount)).cast("double").alias("total"))


def top_with_remainder(rows: DataFrame, order: Sequence[Column], category: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(the first limit rows, counts of the rest by category)."""
    top = rows.orderBy(*order).limit(limit)
    rest = rows.groupBy(category).count().join(top.groupBy(category).agg(F.count(F.lit(1)).alias("shown")), category, "left")
    return top, rest.select(category, (F.col("count") - F.coalesce("shown", F.lit(0))).alias("n")).where("n > 0")


def latest_within(rows: DataFrame, group: str, at: str, columns: Sequence[str]) -> DataFrame:
    """The group's rows as an array, newest first."""
    return rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(at, *columns)), asc=False).alias("rows"))
