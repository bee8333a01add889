"""Duplicates inside a table and overlap between two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_keep_first(df: DataFrame, order_by: str = "row_id", keys: list[str] | None = None) -> DataFrame:
    """One row per distinct content, keeping the smallest ``order_by`` value.

    Grouping combines copies on the map side, so even a group holding a third of the table moves as a few rows.
    """
    keys = keys or [c for c in df.columns if c != order_by]
    return df.groupBy(*keys).agg(F.min(order_by).alias(order_by)).select(order_by, *keys)


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct rows and duplicates of one table."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("row_count"),
            F.count(F.lit(1)).alias("distinct_count"),
        )
        .withColumn("duplicate_count", F.col("row_count") - F.col("distinct_count"))
    )


def overlap_count(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Number of distinct rows that occur in both tables; nulls and NaNs compare equal."""
    return left.select(*keys).intersect(right.select(*keys)).agg(F.count(F.lit(1)).alias("overlap_count"))
