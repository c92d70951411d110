"""Dashboard aggregates over products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_group(rows: DataFrame, column: str, name: str = "products") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias(name))


def by_day(rows: DataFrame, ts: str) -> DataFrame:
    return rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("products"))


def kpis(rows: DataFrame, regular: Column, price: Column) -> DataFrame:
    """One row: products, largest saving, all savings."""
    saved = regular - price
    return rows.agg(F.count("*").alias("products"), F.max(saved).alias("max_saving"), F.sum(saved).alias("sum_saving"))


def top_discounts(rows: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    return rows.where(F.col(column) > 0).orderBy(F.desc(column), *ties).limit(n)
