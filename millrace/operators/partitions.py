"""Partitions as something to look at, and heavy keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partition_sizes(table: DataFrame, n: int | None = None, key: str | None = None) -> DataFrame:
    """(partition, n) rows, after hash partitioning by ``key`` if given. Empty
    partitions have no row."""
    if key is not None:
        table = table.repartition(n, key) if n else table.repartition(key)
    return table.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


def dealt_sizes(table: DataFrame, number: Column, n: int) -> DataFrame:
    """(partition, n) rows of a table dealt by a number of one's own, modulo n:
    counted where the rows lie, without moving them."""
    return table.groupBy(F.pmod(number, F.lit(n)).cast("int").alias("partition")).agg(F.count("*").alias("n"))


def heavy_keys(table: DataFrame, key: str, more_than: int) -> DataFrame:
    """(key, n) of the keys with more than so many rows, counted before the
    shuffle."""
    return table.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > more_than)
