"""Findings on amounts: missing, grown, concentrated, at a ceiling, just below a threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def money(c: Column | str, scale: int = 2) -> Column:
    """A double amount as an exact decimal: sums don't depend on the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")


def absent(c: Column) -> Column:
    """NULL and zero both mean that a value is missing."""
    return c.isNull() | (c == 0)


def severity(value: Column, high: float, warning: float | None = None) -> Column:
    """high, warning or info by value; without a warning bound everything below high is a warning."""
    top = F.when(value >= high, "high")
    return top.otherwise("warning") if warning is None else top.when(value >= warning, "warning").otherwise("info")


def missing_value(rows: DataFrame, amounts: Sequence[str], signed: Column | None = None) -> DataFrame:
    """Rows (signed ones, where that is given) on which every amount is missing."""
    all_absent = F.lit(True)
    for a in amounts:
        all_absent = all_absent & absent(F.col(a))
    return rows.where(all_absent if signed is None else signed & all_absent)


def growth_band(rows: DataFrame, before: str, after: str, low: float, high: float) -> DataFrame:
    """Rows whose amount grew by more than low and at most high times; column ratio is added."""
    ratio = F.col(after) / F.col(before)
    grown = (F.col(before) > 0) & (F.col(after) > 0)
    return rows.where(grown).withColumn("ratio", ratio).where((F.col(after) > F.lit(low) * F.col(before)) & (F.col(after) <= F.lit(high) * F.col(before)))


def share_of_total(rows: DataFrame, key: str, amount: str, *, since: Column | None = None, at: str | None = None, min_count: int = 3, min_share: float = 0.15) -> DataFrame:
    """key, n, total, share of the keys that hold at least min_share of all amounts, with min_count rows or more.

    Partial sums are shuffled by key; the grand total is a one-row aggregate of those sums.
    """
    kept = rows.where(~absent(F.col(amount)))
    if at is not None:
        kept = kept.where(F.col(at) >= since)
    by_key = kept.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(money(amount)).alias("total"))
    everything = by_key.agg(F.sum("total").alias("of_all"))
    share = F.col("total").cast("double") / F.col("of_all").cast("double")
    joined = by_key.join(F.broadcast(everything), F.col("of_all") > 0)  # one row
    return joined.withColumn("share", share).where((F.col("n") >= min_count) & (F.col("share") >= min_share)).select(key, "n", F.col("total").cast("double").alias("total"), "share")


def at_ceiling(rows: DataFrame, amount: str, estimate: str, low: float = 0.98, high: float = 1.05) -> DataFrame:
    """Rows whose amount lies between low and high times its estimate."""
    return rows.where(F.col(estimate) > 0).withColumn("ratio", F.col(amount) / F.col(estimate)).where(F.col("ratio").between(low, high))


def near_threshold(rows: DataFrame, amount: str, bands: Sequence[float], within: float = 0.05) -> DataFrame:
    """Rows whose amount is less than one of the bands, by at most the share within; column band is the lowest such band."""
    band = F.lit(None).cast("double")
    for b in sorted(bands, reverse=True):
        band = F.when((F.col(amount) >= F.lit((1 - within) * b)) & (F.col(amount) < F.lit(b)), F.lit(float(b))).otherwise(band)
    return rows.withColumn("band", band).where(F.col("band").isNotNull())


def sole_member(rows: DataFrame, group: str) -> DataFrame:
    """Rows that are the only one of their group."""
    single = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where("__n = 1").select(group)
    return rows.join(single, group, "left_semi")


def lookup(rows: DataFrame, key: str, dimension: DataFrame, how: str = "left") -> DataFrame:
    """Attributes by key from a dimension; Spark broadcasts it where its size is known to be small, as of literal rows."""
    return rows.join(dimension, key, how)


def dimension(spark, columns: Sequence[str], values: Sequence[tuple]) -> DataFrame:
    """A literal dimension, kept inside the plan as VALUES."""
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)
    rows = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in values)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(columns)})")


def reasons(**conditions: Column) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]), lambda x: x.isNotNull())


def totals(rows: DataFrame, keys: Sequence[str], **sums: str) -> DataFrame:
    """Exact sums by keys, as doubles."""
    return rows.groupBy(*keys).agg(*[F.sum(money(c)).cast("double").alias(k) for k, c in sums.items()])


def window_total(rows: DataFrame, keys: Sequence[str], amount: str) -> Column:
    return F.sum(money(amount)).over(Window.partitionBy(*keys))
