"""Table access and small shared bindings of the star schema to the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.amounts import money


class Tables:
    """Tables of one scale folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")


def query(build):
    """(spark, sf_dir) -> DataFrame from a function of Tables."""
    return lambda spark, sf_dir: build(Tables(spark, sf_dir))


def net_by_order(t: Tables) -> DataFrame:
    """o_orderkey and the exact net sum of its lines."""
    net = money(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)
    return t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(net).cast("double").alias("net"))


#: The same in SQL.
NET_BY_ORDER = "SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS net FROM lineitem GROUP BY 1"

FLOOR_DAYS = "CAST(floor((epoch_us({a}) - epoch_us({b})) / 86400000000.0) AS BIGINT)"
