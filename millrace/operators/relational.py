"""Exploration of review-style records.

``reviews`` has user_id, item_id, stars, date (text, year first) and where
words are counted text. Ties are broken by the key, so results never depend on
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import listed, plain_words


def row_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"))


def in_year(reviews: DataFrame, year: str, date: str = "date") -> DataFrame:
    """Rows of a year, by the text before the first four characters end."""
    return reviews.where(F.substring(date, 1, 4) == year)


def distinct_count(table: DataFrame, column: str) -> DataFrame:
    """Exact number of distinct values."""
    return table.agg(F.count_distinct(column).alias("n"))


def top_by_count(table: DataFrame, key: str, m: int) -> DataFrame:
    """The m keys with most rows; ties go to the smaller key."""
    return table.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(m)


def word_counts(table: DataFrame, text: str, stop_words: DataFrame | None = None) -> DataFrame:
    """(word, n) of plain words. Stop words are anti-joined, in whatever number."""
    words = table.select(F.explode(plain_words(F.col(text))).alias("word")).where("word <> ''")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts if stop_words is None else counts.join(stop_words, "word", "left_anti")


def category_averages(reviews: DataFrame, businesses: DataFrame, key: str = "item_id") -> DataFrame:
    """(category, avg_stars, n): mean stars of every category that the reviewed
    businesses list. Reviews are reduced to a sum and a count for each business
    before the join, so the join never sees single reviews."""
    sums = reviews.groupBy(key).agg(F.sum("stars").alias("s"), F.count("stars").alias("n"))
    lists = businesses.where("categories is not null").select(key, F.explode(listed(F.col("categories"))).alias("category"))
    joined = sums.join(lists, key)
    return joined.groupBy("category").agg((F.sum("s") / F.sum("n")).alias("avg_stars"), F.sum("n").alias("n"))


def top_categories(reviews: DataFrame, businesses: DataFrame, n: int, key: str = "item_id") -> DataFrame:
    """The n categories of the best mean, to six places; ties by name."""
    ranked = category_averages(reviews, businesses, key).withColumn("avg_stars", F.round("avg_stars", 6))
    return ranked.orderBy(F.desc("avg_stars"), "category").limit(n)


def located_pairs(reviews: DataFrame, businesses: DataFrame, condition: Column, key: str = "item_id") -> DataFrame:
    """(user_id, item_id) of the reviews of businesses that meet a condition; one
    row for each review."""
    return reviews.join(businesses.where(condition).select(key), key).select("user_id", key)
