"""Deadlines, calendars and gaps. The clock is never read: ``now`` comes from the data or the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, rounded down also where the difference is negative."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(later) - micros(earlier)) / F.lit(DAY)).cast("long")


def local_date(ts: Column, zone: str = "Europe/Sofia") -> Column:
    """The calendar date of a UTC timestamp in a time zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def net_date(text: Column) -> Column:
    """Timestamp of a JSON date like /Date(1700000000000+0200)/; its milliseconds are UTC already."""
    ms = F.regexp_extract(text, r"/Date\((-?\d+)(?:[+-]\d{4})?\)/", 1)
    return F.timestamp_millis(F.when(ms != "", ms).cast("long"))


def late(rows: DataFrame, done: str, due_from: str, deadline: int, grace: int, warning: int, high: int) -> DataFrame:
    """Rows done more than deadline + grace days after due_from; columns days, late and severity are added."""
    days = floor_days(F.col(done), F.col(due_from))
    level = F.when(F.col("late") > high, "high").when(F.col("late") > warning, "warning").otherwise("info")
    return rows.withColumn("days", days).withColumn("late", F.col("days") - deadline).where(F.col("late") > grace).withColumn("severity", level)


def short_deadline(rows: DataFrame, days: str, legal: str, bare: str, margin: int = 5) -> DataFrame:
    """Rows under the bare minimum (violation) or under the legal minimum plus a margin (signal); column tier is added."""
    d = F.col(days)
    tier = F.when(d < F.col(bare), "violation").when(d < F.col(legal) + margin, "signal")
    return rows.where(d >= 0).withColumn("tier", tier).where(F.col("tier").isNotNull())


def missing_periods(present: DataFrame, keys: Sequence[str], period: str, step: str, bounds: DataFrame | None = None) -> DataFrame:
    """(keys, period) combinations without a row, from the first to the last period seen.

    present has one date column period, already cut to the step. Each key's periods are taken from the
    calendar as a set, so no grid of keys and periods is ever made.
    """
    span = (bounds or present).agg(F.min(period).alias("__a"), F.max(period).alias("__b"))
    calendar = span.where("__a IS NOT NULL").select(F.expr(f"sequence(__a, __b, interval {step})").alias("__calendar"))
    seen = present.groupBy(*keys).agg(F.collect_set(period).alias("__seen"))
    with_calendar = seen.join(F.broadcast(calendar))  # one row
    return with_calendar.select(*keys, F.explode(F.array_except("__calendar", "__seen")).alias(period))


def renewal_gaps(rows: DataFrame, key: str, at: str, min_days: int = 300) -> DataFrame:
    """Keys with two rows or more whose consecutive rows are all at least min_days apart."""
    w = Window.partitionBy(key).orderBy(at)
    gaps = rows.select(key, F.datediff(at, F.lag(at).over(w)).alias("gap"))
    return gaps.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("gap").cast("long").alias("min_gap")).where((F.col("n") >= 2) & (F.col("min_gap") >= min_days))


def forward_window_sum(rows: DataFrame, key: str, at: str, amount: str, days: int) -> DataFrame:
    """Adds window_sum and window_n over the rows of the same key dated in [own day, own day + days]."""
    day = F.datediff(F.col(at), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(key).orderBy("__day").rangeBetween(0, days)
    with_day = rows.withColumn("__day", day)
    return with_day.withColumn("window_sum", F.sum(F.col(amount).cast("decimal(18,2)")).over(w).cast("double")).withColumn("window_n", F.count(F.lit(1)).over(w)).drop("__day")


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def previous_period(period: Column) -> Column:
    """YYYY-MM of the month before."""
    return F.date_format(F.add_months(F.to_date(F.concat(period, F.lit("-01"))), -1), "yyyy-MM")
