"""Expressions over arrays of doubles, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant(values: Sequence[float]) -> Column:
    """The values as one text that is folded to one literal before rows are read:
    a literal for each would take a call each and be compiled one by one."""
    if not len(values):
        return F.array().cast("array<double>")
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def scaled_squares(vec: Column, centre: Column, deviation: Column) -> Column:
    """Sum of squared deviations in units of the standard deviation; dimensions
    without spread are left out."""
    parts = F.zip_with(
        F.zip_with(vec, centre, lambda x, c: x - c),
        deviation,
        lambda d, s: F.when(s > 0, (d / s) * (d / s)).otherwise(F.lit(0.0)),
    )
    return F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)


def beyond(vec: Column, centre: Column, deviation: Column, beta: float) -> Column:
    """Whether any component lies more than ``beta`` deviations off."""
    return F.exists(
        F.zip_with(F.zip_with(vec, centre, lambda x, c: F.abs(x - c)), deviation, lambda d, s: d > s * beta), lambda x: x
    )
