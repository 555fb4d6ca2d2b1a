"""Loading of the tables that the queries of this subpackage read, and helper names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(frame: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that ``frame`` does not have, in any case."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
