"""Pairs of members that meet in groups, made where they are counted.

A group of d members has d (d - 1) / 2 pairs. Moved as rows they outweigh their
table many times, and one aggregation before the exchange fills whatever memory
a task has. So what moves is one row for each member of a group, with the list
of the members after it, dealt by that member into parts of a bounded number of
pairs. An aggregation by pair then needs no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from millrace.scratch import materialize

#: Pairs that one task counts, about.
PAIRS_PER_TASK = 2_000_000
#: Members of a longer group are made into rows by several tasks.
CHUNK = 4096
INT_MAX = (1 << 31) - 1


def _lists(table: DataFrame, member: str, group: str, value: str | None = None, size: str | None = None, distinct: bool = False) -> DataFrame:
    """(a, b) and the named extras, dealt by a: a member and the list of the
    members after it in one group."""
    extras = [c for c in (value, size) if c]
    # a given number is kept: compressed sizes, by which parts are put together otherwise, say little of the rows a task holds
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = table.select(F.col(group).alias("g"), F.col(member).alias("m"), *extras).where("g is not null and m is not null").repartition(tasks, "g")
    if distinct:
        known = known.distinct()
    entry = F.array_sort(F.collect_list(F.struct("m", *extras)))
    lists = known.groupBy("g").agg(entry.alias("l")).where("size(l) > 1")
    lists = materialize(lists.select(*[F.col("l").getField(c).alias(c) for c in ("m", *extras)]))
    n = F.size("m").cast("long")
    found = lists.agg(
        F.sum(n * (n - 1) / 2).alias("pairs"), F.max(n).alias("longest"), F.min(F.col("m")[0]).alias("low"), F.max(F.element_at("m", -1)).alias("high")
    ).first()
    parts = max(1, -(-int(found["pairs"] or 0) // PAIRS_PER_TASK))
    if isinstance(table.schema[member].dataType, LongType) and found["high"] is not None and -INT_MAX <= found["low"] and found["high"] <= INT_MAX:
        lists = lists.withColumn("m", F.col("m").cast("array<int>"))
    if (found["longest"] or 0) > CHUNK:
        lists = lists.withColumn("s", F.explode(F.sequence(F.lit(0), F.size("m") - 1, F.lit(CHUNK)))).repartition(parts)
        places = F.posexplode(F.slice("m", F.col("s") + 1, CHUNK))
    else:
        lists = lists.withColumn("s", F.lit(0))
        places = F.posexplode("m")
    placed = lists.select("*", places.alias("i", "a")).withColumn("i", F.col("i") + F.col("s")).where("i < size(m) - 1")
    own = {"x": value, "size": size}
    columns = [F.element_at(c, F.col("i") + 1).alias(name) for name, c in own.items() if c]
    columns += [F.slice(c, F.col("i") + 2, F.size(c)).alias(name) for name, c in {"b": "m", "y": value}.items() if c]
    return placed.select("a", *columns).repartition(parts, "a")


def meetings(table: DataFrame, member: str, group: str, value: str) -> DataFrame:
    """A row (a, b, x, y) for every two members a < b of each group with their
    values, in parts by ``a``. ``table`` holds one row for each member of a group."""
    dealt = _lists(table, member, group, value)
    pairs = dealt.select("a", "x", "y", F.posexplode("b").alias("j", "other"))
    return pairs.select("a", F.col("other").alias("b"), "x", F.element_at("y", F.col("j") + 1).alias("y"))


def meeting_counts(table: DataFrame, member: str, group: str, at_least: int | Column, size: str | None = None, distinct: bool = False) -> DataFrame:
    """(a, b, common): members a < b that meet in ``at_least`` groups or more, a
    number or an expression over ``size``, a column of a. ``table`` holds one row
    for each member of a group, or several equal ones where ``distinct`` is set.

    All lists of a member, put together and sorted, hold another member so often
    in a row: only those places are counted."""
    dealt = _lists(table, member, group, size=size, distinct=distinct)
    joined = dealt.groupBy("a", *(["size"] if size else [])).agg(F.sort_array(F.flatten(F.collect_list("b"))).alias("all"))
    least = F.greatest(F.lit(1), at_least if isinstance(at_least, Column) else F.lit(at_least)).cast("int")
    places = joined.select("a", least.alias("k"), "all", F.posexplode("all").alias("j", "b"))
    often = places.where(F.get("all", F.col("j") + F.col("k") - 1) == F.col("b")).select("a", "b", "k")
    counted = often.groupBy("a", "b", "k").agg(F.count("*").alias("n")).select("a", "b", (F.col("n") + F.col("k") - 1).alias("common"))
    return wide(counted, table, member)


def wide(pairs: DataFrame, like: DataFrame, member: str) -> DataFrame:
    """``pairs`` with a and b of the members' own type again: to be called on
    aggregated pairs, as a cast before would cost their partitioning."""
    kind = like.schema[member].dataType
    return pairs.withColumns({"a": F.col("a").cast(kind), "b": F.col("b").cast(kind)})
