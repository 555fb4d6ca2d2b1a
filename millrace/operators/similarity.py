"""MinHash signatures, locality-sensitive hashing and exact Jaccard similarity.

``members`` is a long table of distinct (owner, member), members being whole
numbers from 0 and below PRIME.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.meetings import meeting_counts
from millrace.scratch import materialize

HASHES = 50
PRIME = 2_147_483_647


def dense_index(table: DataFrame, column: str) -> DataFrame:
    """(column, idx): the distinct values numbered from 0 in their order.

    Values are range-partitioned and numbered within partitions, offset by the
    sizes of the partitions before: no task sees all values. The partitions are
    written once, as both their sizes and their numbers follow from them.
    """
    values = table.select(column).where(F.col(column).isNotNull()).distinct()
    ranged = materialize(values.repartitionByRange(column).withColumn("p", F.spark_partition_id()))
    sizes = ranged.groupBy("p").agg(F.count("*").alias("n"), F.min(column).alias("low"))
    # one row for each partition
    offsets = sizes.withColumn("before", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("low")) - F.col("n"))
    inside = Window.partitionBy("p").orderBy(column)
    numbered = ranged.withColumn("i", F.row_number().over(inside))
    return numbered.join(F.broadcast(offsets.select("p", "before")), "p").select(
        column, (F.col("before") + F.col("i") - 1).alias("idx")
    )


def coefficients(hashes: int) -> list[tuple[int, int]]:
    """Multipliers and increments of the hash functions: powers of two
    generators modulo PRIME, large enough that small numbers wrap around too."""
    return [(pow(48271, h + 1, PRIME), pow(16807, h + 1, PRIME)) for h in range(hashes)]


def _minima(members: DataFrame, hashes: int) -> DataFrame:
    """(owner, h0, h1, ...) in one aggregation, the members being dealt by owner
    before it: rows of so many minima would fill a task that meets all owners."""
    value: list[Column] = [(F.col("member") * a + b) % PRIME for a, b in coefficients(hashes)]
    dealt = members.select("owner", "member").repartition("owner")
    return dealt.groupBy("owner").agg(*[F.min(v).alias(f"h{i}") for i, v in enumerate(value)])


def signatures(members: DataFrame, hashes: int = HASHES) -> DataFrame:
    """(owner, hash_no, min_val): all minima come from one aggregation, so rows
    are not multiplied by the number of hashes before it. Repeated members
    change nothing."""
    lows = _minima(members, hashes)
    return lows.select("owner", F.posexplode(F.array(*[f"h{i}" for i in range(hashes)])).alias("hash_no", "min_val"))


def lsh_candidates(signature: DataFrame, rows: int = 1) -> DataFrame:
    """Distinct (a, b), a < b, that agree in one band of ``rows`` hashes."""
    values = [f"v{j}" for j in range(rows)]
    if rows > 1:
        place = F.expr(f"hash_no % {rows}")
        banded = signature.groupBy("owner", F.expr(f"hash_no div {rows}").alias("band")).agg(
            *[F.max(F.when(place == j, F.col("min_val"))).alias(v) for j, v in enumerate(values)]
        ).select("owner", "band", *[F.coalesce(v, F.lit(-1)).alias(v) for v in values])
    else:
        banded = signature.select("owner", F.col("hash_no").alias("band"), F.col("min_val").alias("v0"))
    left, right = banded.withColumnRenamed("owner", "a"), banded.withColumnRenamed("owner", "b")
    return left.join(right, ["band", *values]).where("a < b").select("a", "b").distinct()


def jaccard(members: DataFrame, pairs: DataFrame, at_least: float) -> DataFrame:
    """(a, b, common, sim) of the pairs whose exact similarity reaches a bound."""
    sizes = members.groupBy("owner").agg(F.count("*").alias("size"))
    left = members.select(F.col("owner").alias("a"), "member")
    right = members.select(F.col("owner").alias("b"), "member")
    common = pairs.join(left, "a").join(right, ["b", "member"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    return _scored(common, sizes, at_least)


def _scored(common: DataFrame, sizes: DataFrame, at_least: float) -> DataFrame:
    sized = common.join(sizes.select(F.col("owner").alias("a"), F.col("size").alias("sa")), "a").join(
        sizes.select(F.col("owner").alias("b"), F.col("size").alias("sb")), "b"
    )
    sim = F.col("common") / (F.col("sa") + F.col("sb") - F.col("common"))
    return sized.select("a", "b", "common", sim.alias("sim")).where(F.col("sim") >= at_least)


def similar_pairs(members: DataFrame, at_least: float, hashes: int = HASHES, rows: int = 1, least_common: int = 1) -> DataFrame:
    """(a, b, common, sim) of the candidates by hashing, verified exactly, that
    share ``least_common`` members at least.

    With one hash a band nearly every pair that shares a member is proposed (at
    a similarity of 1/60 it is 57 % by 50 hashes), and proposals and their
    members outweigh the table many times. So the shared members are counted
    first, and of the pairs that reach the bounds those stay that agree in a
    hash. Bands of several hashes propose few pairs, which are joined with
    their members. ``at_least`` must be above 0.
    """
    if rows > 1:
        found = jaccard(members, lsh_candidates(signatures(members, hashes), rows), at_least)
        return found.where(F.col("common") >= least_common)
    dealt = members.select("owner", "member").repartition("owner").distinct()
    sizes = dealt.groupBy("owner").agg(F.count("*").alias("size"))
    sized = materialize(dealt.join(sizes.hint("merge"), "owner"))
    # the bound for a's size alone: similar owners share at_least of either's members
    least = F.greatest(F.lit(least_common), F.ceil(at_least * F.col("size") - 1e-6))
    common = meeting_counts(sized, "owner", "member", least, size="size")
    close = materialize(_scored(common, sized.select("owner", "size").distinct(), at_least))
    named = close.select(F.explode(F.array("a", "b")).alias("owner")).distinct()
    lows = _minima(sized.join(named, "owner", "left_semi"), hashes).select("owner", F.array(*[f"h{i}" for i in range(hashes)]).alias("h"))
    both = close.join(lows.select(F.col("owner").alias("a"), F.col("h").alias("ha")), "a").join(lows.select(F.col("owner").alias("b"), F.col("h").alias("hb")), "b")
    agreed = F.exists(F.zip_with("ha", "hb", lambda x, y: x == y), lambda x: x)
    return both.where(agreed).select("a", "b", "common", "sim")
