"""Collaborative filtering: similarity models, predictions, error.

Pearson similarity is taken over common raters, from sums of ratings counted
from CENTRE, in one aggregation over the pairs; a spread below FLAT counts as
none and gives no similarity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from millrace.operators.meetings import meetings, wide
from millrace.operators.similarity import dense_index, similar_pairs
from millrace.scratch import materialize

CENTRE = 3.0
FLAT = 1e-9
MIN_COMMON = 3


def mean_ratings(ratings: DataFrame) -> DataFrame:
    """(user_id, item_id, stars): repeated ratings averaged."""
    return ratings.groupBy("user_id", "item_id").agg(F.avg("stars").alias("stars"))


def _pearson(pairs: DataFrame) -> DataFrame:
    """(a, b, common, sim) from rows (a, b, x, y)."""
    x, y = F.col("x") - CENTRE, F.col("y") - CENTRE
    sums = pairs.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy"),
    ).where(F.col("n") >= MIN_COMMON)
    n = F.col("n")
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / n, F.col("yy") - F.col("sy") * F.col("sy") / n
    cov = F.col("xy") - F.col("sx") * F.col("sy") / n
    sim = F.when((vx > FLAT) & (vy > FLAT), cov / F.sqrt(vx * vy)).otherwise(F.lit(0.0))
    return sums.select("a", "b", F.col("n").alias("common"), sim.alias("sim"))


def item_model(ratings: DataFrame, above: float = 1e-4) -> DataFrame:
    """(a, b, common, sim), a < b, of items with three common raters at least.

    Pairs come from the lists of a rater's items: items without a common rater
    never meet. ``ratings`` must hold one row for each (user, item).
    """
    found = _pearson(meetings(ratings, "item_id", "user_id", value="stars")).where(F.round("sim", 9) > above)
    return wide(found, ratings, "item_id")


def user_model(ratings: DataFrame, jaccard_at_least: float = 0.01, at_least: float = 1e-6, hashes: int = 50) -> DataFrame:
    """(a, b, common, sim), a < b, of users that hashing proposes, whose item sets
    are similar enough and share three items at least. Items that are not whole
    numbers are numbered for the hashing."""
    members = ratings.select(F.col("user_id").alias("owner"), F.col("item_id").alias("member"))
    if not isinstance(members.schema["member"].dataType, IntegralType):
        members = members.join(dense_index(members, "member"), "member").select("owner", F.col("idx").alias("member"))
    near = materialize(similar_pairs(members, jaccard_at_least, hashes, least_common=MIN_COMMON).select("a", "b"))
    left = ratings.select(F.col("user_id").alias("a"), "item_id", F.col("stars").alias("x"))
    right = ratings.select(F.col("user_id").alias("b"), "item_id", F.col("stars").alias("y"))
    return _pearson(near.join(left, "a").join(right, ["b", "item_id"])).where(F.round("sim", 9) >= at_least)


def both_ways(model: DataFrame) -> DataFrame:
    """(me, other, sim) of a model that holds each pair once."""
    return model.select(F.col("a").alias("me"), F.col("b").alias("other"), "sim").unionByName(
        model.select(F.col("b").alias("me"), F.col("a").alias("other"), "sim")
    )


def predict_by_items(pairs: DataFrame, ratings: DataFrame, model: DataFrame, n: int = 7) -> DataFrame:
    """(user_id, item_id, pred): mean of the user's ratings of the n most similar
    items, weighted by similarity; pairs without any are left out."""
    near = (
        pairs.select("user_id", "item_id").distinct()
        .join(ratings.select("user_id", F.col("item_id").alias("other"), "stars"), "user_id")
        .join(both_ways(model).withColumnRenamed("me", "item_id"), ["item_id", "other"])
        .withColumn("sim", F.round("sim", 9))
    )
    order = Window.partitionBy("user_id", "item_id").orderBy(F.desc("sim"), "other")
    best = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    return best.groupBy("user_id", "item_id").agg((F.sum(F.col("sim") * F.col("stars")) / F.sum("sim")).alias("pred"))


def _meeting(left: DataFrame, right: DataFrame, key: str) -> int:
    """Rows of the join by ``key``, from the keys' numbers alone."""
    sides = [t.groupBy(key).agg(F.count("*").alias(n)) for t, n in ((left, "n"), (right, "m"))]
    return sides[0].join(sides[1], key).agg(F.sum(F.col("n") * F.col("m")).alias("r")).first()["r"] or 0


def predict_by_users(pairs: DataFrame, ratings: DataFrame, model: DataFrame, n: int = 5) -> DataFrame:
    """(user_id, item_id, pred): the user's mean plus the weighted deviations of
    the n most similar users who rated the item from their means; without any,
    the item's mean; without that the pair is left out."""
    wanted = pairs.select("user_id", "item_id").distinct()
    means = ratings.groupBy("user_id").agg(F.avg("stars").alias("mean"))
    deviations = ratings.join(means, "user_id").select(
        F.col("user_id").alias("other"), "item_id", (F.col("stars") - F.col("mean")).alias("d")
    )
    ways = both_ways(model).withColumnRenamed("me", "user_id")
    if _meeting(wanted, ways, "user_id") < _meeting(wanted, ratings, "item_id"):
        near = wanted.join(ways, "user_id").join(deviations, ["item_id", "other"])
    else:
        near = wanted.join(deviations, "item_id").join(ways, ["user_id", "other"])
    near = near.withColumn("sim", F.round("sim", 9))
    order = Window.partitionBy("user_id", "item_id").orderBy(F.desc("sim"), "other")
    best = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    shift = best.groupBy("user_id", "item_id").agg((F.sum(F.col("sim") * F.col("d")) / F.sum(F.abs("sim"))).alias("shift"))
    item_means = ratings.groupBy("item_id").agg(F.avg("stars").alias("item_mean"))
    joined = wanted.join(shift, ["user_id", "item_id"], "left").join(means, "user_id", "left").join(item_means, "item_id", "left")
    pred = F.coalesce(F.col("mean") + F.col("shift"), F.col("item_mean"))
    return joined.select("user_id", "item_id", pred.alias("pred")).where("pred is not null")


def predict_by_mean(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """(user_id, item_id, pred): the item's mean rating."""
    means = ratings.groupBy("item_id").agg(F.avg("stars").alias("pred"))
    return pairs.select("user_id", "item_id").distinct().join(means, "item_id").select("user_id", "item_id", "pred")


def with_fallback(truth: DataFrame, predictions: DataFrame, ratings: DataFrame, key: str = "item_id") -> DataFrame:
    """``truth`` with ``pred``: the prediction, else the mean of the ``key``'s
    ratings; rows with neither are left out."""
    means = ratings.groupBy(key).agg(F.avg("stars").alias("fallback"))
    joined = truth.join(predictions.select("user_id", "item_id", "pred"), ["user_id", "item_id"], "left").join(means, key, "left")
    return joined.withColumn("pred", F.coalesce("pred", "fallback")).drop("fallback").where("pred is not null")
