"""Review-style frames over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STOP_WORDS = ("a", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "not", "of", "on", "or", "than", "that", "the", "this", "to", "was", "with")
GRAPH_THRESHOLD = 7
TEST_SHARE = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reviews(spark: SparkSession, sf_dir: str, item: str) -> DataFrame:
    """(order_id, user_id, item_id, stars, date): every order line as a review
    of the part or supplier in ``item``."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(item).alias("item_id"), "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    stars = 1 + (F.col("l_quantity").cast("int") - 1) % 5
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        "item_id",
        stars.cast("double").alias("stars"),
        F.col("o_orderdate").cast("string").alias("date"),
    )


def part_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir, "l_partkey")


def supplier_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir, "l_suppkey")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, categories): a part's brand and type as one text."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.concat_ws(", ", "p_brand", "p_type").alias("categories"))


def located_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, nations = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    joined = suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"])
    return joined.select(F.col("s_suppkey").alias("item_id"), F.col("n_name").alias("state"))


def brand_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, p_brand) of every order line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select("l_orderkey", "p_brand")


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")


def held_out(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and test reviews: every tenth order tests."""
    test = F.col("order_id") % TEST_SHARE == 0
    return reviews.where(~test), reviews.where(test)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers who bought seven or more of the same parts."""
    from millrace.operators.graph import cooccurrence

    return cooccurrence(part_reviews(spark, sf_dir), "user_id", "item_id", GRAPH_THRESHOLD)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec, label) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
    )
