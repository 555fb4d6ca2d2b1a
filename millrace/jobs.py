"""Whole jobs, from input files to report files, also as commands:
``python -m millrace.jobs NAME ARGUMENT...``.

Inputs are those of ``sources.readers``, outputs those of ``sources.reports``.
A review's business is its item.
"""

from __future__ import annotations

import inspect
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import clustering, graph, itemsets, metrics, partitions, profiles, ratings, relational, similarity
from millrace.scratch import materialize
from millrace.sources import readers, reports


def explore(spark: SparkSession, reviews: str, output: str, stop_words: str, year: str, users: int, words: int) -> None:
    """Counts of reviews, reviews of a year and users; most active users; most
    frequent words."""
    table = readers.reviews(spark, reviews)
    counts = relational.word_counts(table, "text", readers.word_list(spark, stop_words))
    reports.exploration(
        output,
        relational.row_count(table).first()["n"],
        relational.row_count(relational.in_year(table, str(year))).first()["n"],
        relational.distinct_count(table, "user_id").first()["n"],
        [tuple(r) for r in relational.top_by_count(table, "user_id", int(users)).collect()],
        [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(int(words)).collect()],
    )


def rank_categories(spark: SparkSession, reviews: str, businesses: str, output: str, n: int) -> None:
    """The categories of the best mean rating."""
    best = relational.top_categories(readers.reviews(spark, reviews), readers.businesses(spark, businesses), int(n), "business_id")
    reports.ranking(output, best.select("category", "avg_stars"))


def report_partitions(spark: SparkSession, reviews: str, output: str, more_than: int, n_partitions: int = 0) -> None:
    """Sizes of the partitions, as read or dealt by business into so many, and
    the businesses with more than so many reviews."""
    table = readers.reviews(spark, reviews).select("business_id")
    n = int(n_partitions)
    sizes = {r["partition"]: r["n"] for r in partitions.partition_sizes(table, n, "business_id" if n else None).collect()}
    total = n or max(sizes, default=-1) + 1
    heavy = partitions.heavy_keys(table, "business_id", int(more_than)).orderBy("business_id")
    reports.partition_report(output, total, [sizes.get(i, 0) for i in range(total)], heavy)


def pairs_of_state(spark: SparkSession, reviews: str, businesses: str, output: str, state: str = "NV") -> None:
    """User and business of every review of a business in a state, as CSV."""
    found = relational.located_pairs(readers.reviews(spark, reviews), readers.businesses(spark, businesses), F.col("state") == state, "business_id")
    reports.csv_with_header(output, found)


def mine_itemsets(spark: SparkSession, pairs: str, output: str, support: int, case: int = 1, larger_than: int = 0, parts: int = 2) -> None:
    """Candidates and frequent sets by two passes: of businesses by user (case
    1) or of users by business (case 2), baskets of more than so many items."""
    names = ("user_id", "business_id") if int(case) == 1 else ("business_id", "user_id")
    baskets = materialize(itemsets.baskets_of(readers.pairs(spark, pairs), *names, int(larger_than)))
    wanted = itemsets.local_candidates(baskets, int(support), int(parts))
    found = itemsets.count_sets(baskets, wanted, int(support))
    reports.itemsets(output, [r["items"] for r in wanted.collect()], [r["items"] for r in found.collect()])


def similar_businesses(spark: SparkSession, reviews: str, output: str, at_least: float = 0.05) -> None:
    """Pairs of businesses whose reviewers are alike, by hashing and exact Jaccard."""
    table = readers.reviews(spark, reviews).select("business_id", "user_id").distinct()
    members = table.join(similarity.dense_index(table, "user_id"), "user_id").select(F.col("business_id").alias("owner"), F.col("idx").alias("member"))
    found = similarity.similar_pairs(materialize(members), float(at_least))
    reports.pair_model(output, found, "b1", "b2")


def train_profiles(spark: SparkSession, reviews: str, model: str, stop_words: str, terms: int = 200) -> None:
    """Profiles of businesses, their heaviest terms, and of users, those of the
    businesses they reviewed."""
    table = readers.reviews(spark, reviews)
    counts = profiles.term_counts(table, "business_id", "text", readers.word_list(spark, stop_words))
    top = materialize(profiles.top_terms(profiles.term_weights(counts), int(terms)).select("doc", "term"))
    numbered = top.join(similarity.dense_index(top, "term"), "term").select("doc", F.col("idx").alias("term"))
    pairs = table.select(F.col("user_id").alias("user"), F.col("business_id").alias("doc"))
    users = profiles.user_profiles(pairs, numbered)
    reports.profiles(model, {"business": numbered.withColumnRenamed("doc", "id"), "user": users.withColumnRenamed("user", "id")})


def predict_by_profiles(spark: SparkSession, test: str, model: str, output: str, at_least: float = 0.01) -> None:
    """Cosine of the profiles of user and business for every pair."""
    users = readers.profiles(spark, model, "user").withColumnRenamed("id", "user")
    docs = readers.profiles(spark, model, "business").withColumnRenamed("id", "doc")
    pairs = readers.json_lines(spark, test, readers.PAIR).select(F.col("user_id").alias("user"), F.col("business_id").alias("doc")).distinct()
    found = profiles.profile_cosine(pairs, users, docs, float(at_least))
    reports.json_rows(output, found.select(F.col("user").alias("user_id"), F.col("doc").alias("business_id"), "sim"))


def _ratings(spark: SparkSession, path: str) -> DataFrame:
    table = readers.json_lines(spark, path, readers.PREDICTION).withColumnRenamed("business_id", "item_id")
    return materialize(ratings.mean_ratings(table))


def train_similarities(spark: SparkSession, reviews: str, model: str, kind: str = "item_based") -> None:
    """Pearson model of businesses (``item_based``) or of users (``user_based``)."""
    table = _ratings(spark, reviews)
    if kind == "item_based":
        reports.pair_model(model, ratings.item_model(table), "b1", "b2")
    else:
        reports.pair_model(model, ratings.user_model(table), "u1", "u2")


def predict_ratings(spark: SparkSession, train: str, test: str, model: str, output: str, kind: str = "item_based") -> None:
    """Predicted stars of user and business pairs."""
    known = _ratings(spark, train)
    pairs = readers.json_lines(spark, test, readers.PAIR).withColumnRenamed("business_id", "item_id")
    predict = ratings.predict_by_items if kind == "item_based" else ratings.predict_by_users
    found = predict(pairs, known, readers.pair_model(spark, model))
    reports.json_rows(output, found.select("user_id", F.col("item_id").alias("business_id"), F.col("pred").alias("stars")))


def rating_error(spark: SparkSession, truth: str, predicted: str, averages: str, kind: str = "item_based") -> float | None:
    """Root mean square error; a pair without a prediction takes the mean of
    its business (``item_based``) or user from a JSON object, which may hold a
    mean for unknown ones under ``UNK``."""
    key = "item_id" if kind == "item_based" else "user_id"
    true = readers.json_lines(spark, truth, readers.PREDICTION).withColumnRenamed("business_id", "item_id")
    found = readers.json_lines(spark, predicted, readers.PREDICTION).select("user_id", F.col("business_id").alias("item_id"), F.col("stars").alias("pred"))
    means = readers.number_map(spark, averages).select(F.col("key").alias(key), F.col("value").alias("mean"))
    other = means.where(F.col(key) == "UNK").first()
    joined = true.join(found, ["user_id", "item_id"], "left").join(means, key, "left")
    filled = F.coalesce("pred", "mean", F.lit(other["mean"] if other else None).cast("double"))
    return metrics.rmse(joined.withColumn("pred", filled).where("pred is not null")).first()["rmse"]


def _graph(spark: SparkSession, pairs: str, threshold: int) -> DataFrame:
    return materialize(graph.cooccurrence(readers.pairs(spark, pairs), "user_id", "business_id", int(threshold)).select("src", "dst"))


def find_communities(spark: SparkSession, threshold: int, pairs: str, output: str) -> None:
    """Communities of users by label propagation."""
    reports.communities(output, graph.label_propagation(_graph(spark, pairs, threshold)), group="label")


def cut_communities(spark: SparkSession, threshold: int, pairs: str, edges: str, output: str) -> None:
    """Betweenness of all edges, and the communities of best modularity that
    cutting the edges of highest betweenness leaves."""
    found = _graph(spark, pairs, threshold)
    reports.betweenness(edges, graph.betweenness(found))
    reports.communities(output, graph.girvan_newman(found))


def cluster_folder(spark: SparkSession, folder: str, k: int, output: str, rounds: str) -> None:
    """Clusters of the points of a folder, one file a round, and the counts
    after each round."""
    batches = (readers.points(spark, path) for path in readers.round_paths(spark, folder))
    labels, found = clustering.cluster_rounds(batches, int(k))
    reports.cluster_map(output, labels)
    reports.round_summaries(rounds, [vars(r) for r in found])


def compare_clusters(spark: SparkSession, truth: str, predicted: str) -> float | None:
    """Normalised mutual information of two cluster maps, over the points of both."""
    one, other = (readers.number_map(spark, path).withColumnRenamed("value", name) for path, name in ((truth, "truth"), (predicted, "found")))
    return metrics.nmi(one.join(other, "key"), "truth", "found").first()["nmi"]


JOBS = (
    explore, rank_categories, report_partitions, pairs_of_state, mine_itemsets, similar_businesses, train_profiles, predict_by_profiles,
    train_similarities, predict_ratings, rating_error, find_communities, cut_communities, cluster_folder, compare_clusters,
)


def main(arguments: list[str]) -> None:
    jobs = {j.__name__: j for j in JOBS}
    if not arguments or arguments[0] not in jobs:
        listed = (f"  {n} {' '.join(str(p) for p in list(inspect.signature(j).parameters.values())[1:])}" for n, j in jobs.items())
        sys.exit("python -m millrace.jobs NAME ARGUMENT..., of:\n" + "\n".join(listed))
    result = jobs[arguments[0]](SparkSession.builder.appName(arguments[0]).getOrCreate(), *arguments[1:])
    if result is not None:
        print(result)


if __name__ == "__main__":
    main(sys.argv[1:])
