"""Quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rmse(table: DataFrame, truth: str = "stars", pred: str = "pred") -> DataFrame:
    """(rmse, n): root of the mean squared error; null without rows."""
    error = F.col(pred) - F.col(truth)
    return table.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count("*").alias("n"))


def share(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(share): rows found over rows asked; null when none were asked."""
    counts = found.agg(F.count("*").alias("f")).crossJoin(asked.agg(F.count("*").alias("a")))
    return counts.select(F.try_divide("f", "a").alias("share"))


def nmi(table: DataFrame, a: str, b: str) -> DataFrame:
    """(nmi): mutual information over the mean of both entropies, from one
    contingency table; 1 if both labelings have a single value."""
    cells = table.groupBy(a, b).agg(F.count("*").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("ra"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("cb"))
    total = cells.agg(F.sum("n").alias("total"))
    full = cells.join(rows, a).join(cols, b).crossJoin(total)
    p = F.col("n") / F.col("total")
    mutual = full.agg(F.sum(p * F.log(F.col("n") * F.col("total") / (F.col("ra") * F.col("cb")))).alias("mi"))

    def entropy(counts: DataFrame, column: str, name: str) -> DataFrame:
        q = F.col(column) / F.col("total")
        return counts.crossJoin(total).agg((-F.sum(q * F.log(q))).alias(name))

    joined = mutual.crossJoin(entropy(rows, "ra", "ha")).crossJoin(entropy(cols, "cb", "hb"))
    mean = (F.col("ha") + F.col("hb")) / 2
    return joined.select(F.when(mean > 0, F.col("mi") / mean).otherwise(F.lit(1.0)).alias("nmi"))
