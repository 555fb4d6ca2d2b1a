"""Frequent itemsets, level by level, as joins and aggregations.

Level k joins the frequent (k-1)-sets on their common prefix, keeps those all
of whose subsets are frequent, and counts them against the baskets. Equal
baskets are one row with their number. An occurrence of a set keeps the items
that come after it in its basket, so counting extends occurrences of the prefix
set by one item each: no basket is ever compared with all candidates, and no
join with the baskets is needed. Each level's occurrences are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import materialize

PAIR_BUCKETS = 1 << 16


def baskets_of(pairs: DataFrame, basket: str, item: str, larger_than: int = 0) -> DataFrame:
    """Distinct (basket, item); only baskets of more than so many items. Swap
    the two names for the other orientation."""
    table = pairs.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where(
        "basket is not null and item is not null"
    ).repartition("basket").distinct()
    if larger_than:
        large = table.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > larger_than).select("basket")
        table = table.join(large, "basket", "left_semi")
    return table


def names(k: int) -> list[str]:
    return [f"i{j}" for j in range(1, k + 1)]


def frequent_items(baskets: DataFrame, support: int) -> DataFrame:
    """(i1, n) with n of ``support`` or more."""
    return baskets.groupBy(F.col("item").alias("i1")).agg(F.count("*").alias("n")).where(F.col("n") >= support)


def collapsed(baskets: DataFrame, *keys: str) -> DataFrame:
    """(keys, rest, w): the sorted items of a basket and how many baskets of the
    same keys hold just these."""
    whole = baskets.groupBy("basket", *keys).agg(F.array_sort(F.collect_list("item")).alias("rest"))
    return whole.groupBy(*keys, "rest").agg(F.count("*").alias("w"))


def extended(places: DataFrame, item: str) -> DataFrame:
    """Every occurrence with each item that comes after it as a column ``item``;
    ``rest`` becomes what comes after that."""
    kept = [c for c in places.columns if c != "rest"]
    long = places.select(*kept, "rest", F.posexplode("rest").alias("_at", item))
    return long.select(*kept, item, F.slice("rest", F.col("_at") + 2, F.size("rest")).alias("rest"))


def pair_filter(pairs: DataFrame, support: int, buckets: int = PAIR_BUCKETS) -> DataFrame:
    """Drops occurrences, each of ``w`` baskets, of pairs whose hash bucket is too
    light for any of its pairs to be frequent. Changes no answer."""
    hashed = pairs.withColumn("bucket", F.pmod(F.xxhash64("i1", "i2"), F.lit(buckets)))
    heavy = hashed.groupBy("bucket").agg(F.sum("w").alias("n")).where(F.col("n") >= support).select("bucket")
    return hashed.join(heavy, "bucket", "left_semi").drop("bucket")


def candidates(frequent: DataFrame, k: int) -> DataFrame:
    """Sets of k items, k being 3 or more, whose (k-1)-subsets are all in ``frequent``."""
    prefix, last = names(k - 2), f"i{k - 1}"
    left = frequent.select(*prefix, last)
    right = frequent.select(*prefix, F.col(last).alias(f"i{k}"))
    joined = left.join(right, prefix).where(F.col(last) < F.col(f"i{k}")).select(*names(k))
    for gone in range(1, k - 1):
        rest = [n for n in names(k) if n != f"i{gone}"]
        subset = frequent.select(*[F.col(a).alias(b) for a, b in zip(names(k - 1), rest, strict=True)])
        joined = joined.join(subset, rest, "left_semi")
    return joined


def frequent_sets(baskets: DataFrame, support: int, longest: int | None = None, hash_pairs: bool = False) -> list[DataFrame]:
    """Frames of (i1..ik, n) for k = 1, 2, ... while there are any, at most
    ``longest`` levels."""
    level = materialize(frequent_items(baskets, support))
    found, k = [], 1
    kept = baskets.join(level.select(F.col("i1").alias("item")), "item", "left_semi")
    places = extended(materialize(collapsed(kept)), "i1")
    while not level.isEmpty():
        found.append(level)
        k += 1
        if longest is not None and k > longest:
            break
        places = extended(places, f"i{k}")
        if k == 2 and hash_pairs:
            places = pair_filter(places, support)
        if k > 2:
            places = places.join(candidates(level, k), names(k), "left_semi")
        level = materialize(places.groupBy(*names(k)).agg(F.sum("w").alias("n")).where(F.col("n") >= support))
        if longest is None or k < longest:
            places = materialize(places.where("size(rest) > 0").join(level.select(*names(k)), names(k), "left_semi"))
    return found


def local_candidates(baskets: DataFrame, support: int, parts: int, longest: int | None = None) -> DataFrame:
    """(items): sets that are frequent in a part of the baskets for a
    proportional support. Sets grow until no part has a frequent one, or to
    ``longest`` items."""
    dealt = baskets.withColumn("part", F.pmod(F.xxhash64("basket"), F.lit(parts)))
    least = -(-support // parts)
    columns = ["part", "item"]
    single = dealt.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    local = dealt.join(single.select(*columns), columns, "left_semi")
    every = single.select(F.array("item").alias("items")).distinct()
    places = extended(materialize(collapsed(local, "part")), "item").withColumn("items", F.array("item")).drop("item")
    k = 1
    while (longest is None or k < longest) and not places.isEmpty():
        k += 1
        places = _grown(places)
        held = materialize(places.groupBy("part", "items").agg(F.sum("w").alias("n")).where(F.col("n") >= least).select("part", "items"))
        every = every.unionByName(held.select("items").distinct())
        places = materialize(places.where("size(rest) > 0").join(held, ["part", "items"], "left_semi"))
    return materialize(every.distinct())


def _grown(places: DataFrame) -> DataFrame:
    longer = extended(places, "item")
    return longer.withColumn("items", F.concat("items", F.array("item"))).drop("item")


def count_sets(baskets: DataFrame, wanted: DataFrame, support: int) -> DataFrame:
    """(items, n) of the wanted sets that so many baskets hold. Occurrences grow
    along the first items of wanted sets, whose items are in order."""
    wanted = wanted.select("items")
    longest = wanted.agg(F.max(F.size("items")).alias("k")).first()["k"] or 0
    used = wanted.select(F.explode("items").alias("item")).distinct()
    places = materialize(collapsed(baskets.join(used, "item", "left_semi")))
    places = places.withColumn("items", F.slice("rest", 1, 0))
    counts = wanted.select("items", F.lit(0).cast("long").alias("n")).limit(0)
    for k in range(1, longest + 1):
        first = wanted.where(F.size("items") >= k).select(F.slice("items", 1, k).alias("items")).distinct()
        places = materialize(_grown(places).join(first, "items", "left_semi"))
        counts = counts.unionByName(places.groupBy("items").agg(F.sum("w").alias("n")).where(F.col("n") >= support))
    return counts.join(wanted, "items", "left_semi")


def two_pass(baskets: DataFrame, support: int, parts: int, longest: int | None = None) -> DataFrame:
    """(items, n) by two passes: the local candidates are counted over all
    baskets. A set that is frequent overall is so in one part at least."""
    return count_sets(baskets, local_candidates(baskets, support, parts, longest), support)
