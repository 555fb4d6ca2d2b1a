"""Memory of Python workers and of the batches sent to them."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch sent to Python. Spark's own bound on batches, by rows, lets
#: whole texts grow to tens of megabytes in the executor and again in the worker.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Returns freed memory to the system. Workers outlive their tasks and wait
    beside those of the next stage; the allocators would keep what the last
    batches took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function over an iterator of batches, giving memory back when a
    task's batches are through."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def bound_batches(spark: SparkSession) -> None:
    """Holds the session's batches to BATCH_BYTES, unless it has a bound set. A
    batch still holds one row, however long."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def map_batches(frame: DataFrame, run: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """``frame.mapInArrow`` of ``run`` with bounded batches, giving memory back."""
    bound_batches(frame.sparkSession)
    return frame.mapInArrow(frugal(run), schema)
