"""Cumulative ledgers over periods: latest and representative periods, changes, jumps, fill-down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(rows: DataFrame, period: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of the latest period, of all rows or within keys (such as the year)."""
    last = rows.groupBy(*keys).agg(F.max(period).alias("__last")) if keys else rows.agg(F.max(period).alias("__last"))
    on = [rows[k].eqNullSafe(last[k]) for k in keys] + [rows[period] == last["__last"]]
    return rows.join(last, on, "left_semi")


def representative_period(rows: DataFrame, period: str) -> DataFrame:
    """Per year the period ending in -12, or else the last one; is_fallback says which."""
    year = F.substring(period, 1, 4)
    full = F.max(F.when(F.col(period).endswith("-12"), F.col(period)))
    return rows.groupBy(year.alias("year")).agg(F.coalesce(full, F.max(period)).alias("period"), full.isNull().alias("is_fallback"))


def period_changes(rows: DataFrame, keys: Sequence[str], period: str, amount: str, min_delta: float) -> DataFrame:
    """Amounts against those of the previous period in the data, where both have the key and differ by more than min_delta.

    Periods are ranked over the distinct periods only; the self-join is on keys and rank.
    """
    ranks = rows.select(period).distinct().withColumn("rank", F.dense_rank().over(Window.orderBy(period)))
    ranked = rows.join(ranks, period)
    before = ranked.select(*keys, (F.col("rank") + 1).alias("rank"), F.col(period).alias("previous_period"), F.col(amount).alias("previous_amount"))
    delta = F.col(amount) - F.col("previous_amount")
    return ranked.join(before, [*keys, "rank"]).withColumn("delta", delta).where(F.abs("delta") > min_delta).drop("rank")


def jumps(rows: DataFrame, keys: Sequence[str], period: str, amount: str, min_ratio: float, min_delta: float, same: Column | None = None) -> DataFrame:
    """Consecutive rows of a key (in one ``same`` span, such as the year) that rose by min_ratio and more than min_delta."""
    w = Window.partitionBy(*keys).orderBy(period)
    span = F.lit(1) if same is None else same
    prev = rows.withColumn("previous", F.lag(amount).over(w)).withColumn("previous_period", F.lag(period).over(w)).withColumn("__span", F.lag(span).over(w))
    rose = (F.col("previous") > 0) & (F.col(amount) - F.col("previous") > min_delta) & (F.col(amount) >= F.lit(min_ratio) * F.col("previous"))
    return prev.where((F.col("__span") == span) & (F.col("previous_period") != F.col(period)) & rose).drop("__span")


def newcomers(rows: DataFrame, keys: Sequence[str], period: str, amount: str, min_amount: float) -> DataFrame:
    """A key's first row, where its period isn't the data's first one and the amount exceeds min_amount."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(period))
    start = rows.agg(F.min(period).alias("__start"))
    return rows.withColumn("__first", first).where("__first = 1").join(F.broadcast(start), F.col(period) > F.col("__start")).where(F.col(amount) > min_amount).drop("__first", "__start")


def fill_down(rows: DataFrame, group: Sequence[str], order: str, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """The last non-null value up to each row of its group: headers that hold for the rows below them."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def subtotal_mismatches(details: DataFrame, subtotals: DataFrame, keys: Sequence[str], amount: str, subtotal: str, tolerance: float = 1.0) -> DataFrame:
    """Given subtotals that differ from the sums of their details by more than tolerance."""
    sums = details.groupBy(*keys).agg(F.sum(F.col(amount).cast("decimal(18,2)")).alias("summed"))
    off = F.abs(F.col("summed") - F.col(subtotal).cast("decimal(18,2)"))
    return subtotals.join(sums, list(keys)).withColumn("difference", off).where(F.col("difference") > tolerance)


def rollup_sums(rows: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Detail, subtotal and grand total rows; level is the number of keys that are kept."""
    level = F.lit(0)
    for k in keys:
        level = level + (1 - F.grouping(k))
    return rows.rollup(*keys).agg(F.sum(F.col(amount).cast("decimal(18,2)")).cast("double").alias("total"), F.count(F.lit(1)).alias("n"), level.cast("long").alias("level"))


def episodes(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """rows with column episode: it goes up wherever a key's sorted values of at lie more than gap apart."""
    w = Window.partitionBy(key).orderBy(at)
    new = (F.col(at) - F.lag(at).over(w) > gap).cast("long")
    return rows.withColumn("__new", F.coalesce(new, F.lit(0))).withColumn("episode", F.sum("__new").over(w)).drop("__new")
