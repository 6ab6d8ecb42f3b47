"""Exports of views: CSV, JSON and GeoJSON, and partitions replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Header and sorted rows; arrays and structs as JSON text."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    (flat.orderBy(*order) if order else flat).write.mode("overwrite").option("header", True).csv(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def features(df: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One GeoJSON feature per row, as text in column feature; geometry is a struct of type and coordinates."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite the partitions of df's values of by, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
