"""All named queries of the mining operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import clustering, graph, itemsets, metrics, partitions, profiles, ratings, relational, similarity
from millrace.plans import domain, sql
from millrace.scratch import checkpointed, materialize

YEAR = "1997"
TOP_TERMS = 20
KMEANS_K, KMEANS_ROUNDS = 5, 3


def _category_avg_topk(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_categories(domain.part_reviews(spark, d), domain.categories(spark, d), 10)


def _review_count(spark, d):
    return relational.row_count(domain.part_reviews(spark, d))


def _reviews_in_year(spark, d):
    return relational.row_count(relational.in_year(domain.part_reviews(spark, d), YEAR))


def _distinct_users(spark, d):
    return relational.distinct_count(domain.part_reviews(spark, d), "user_id")


def _top_users(spark, d):
    return relational.top_by_count(domain.part_reviews(spark, d), "user_id", 10)


def _top_words(spark, d):
    counts = relational.word_counts(domain.table(spark, d, "documents"), "text", domain.stop_words(spark))
    return counts.orderBy(F.desc("n"), "word").limit(20)


def _partition_sizes(spark, d):
    return partitions.dealt_sizes(domain.part_reviews(spark, d), F.col("item_id"), 8)


def _heavy_items(spark, d):
    return partitions.heavy_keys(domain.part_reviews(spark, d), "item_id", 30)


def _state_user_item(spark, d):
    return relational.located_pairs(domain.supplier_reviews(spark, d), domain.located_suppliers(spark, d), F.col("state") == "NATION_9")


def _brand_baskets(spark, d, larger_than=0):
    return itemsets.baskets_of(domain.brand_lines(spark, d), "l_orderkey", "p_brand", larger_than)


def _level(sets: list[DataFrame], k: int, spark: SparkSession) -> DataFrame:
    if len(sets) >= k:
        return sets[k - 1]
    return spark.createDataFrame([], ", ".join(f"{n} string" for n in itemsets.names(k)) + ", n long")


def _freq_items(spark, d):
    return itemsets.frequent_items(_brand_baskets(spark, d), 70)


def _freq_pairs(spark, d):
    return _level(itemsets.frequent_sets(_brand_baskets(spark, d), 70, 2, hash_pairs=True), 2, spark)


def _freq_triples(spark, d):
    return _level(itemsets.frequent_sets(_brand_baskets(spark, d), 70, 3), 3, spark)


def _freq_itemsets_filtered(spark, d):
    found = itemsets.frequent_sets(_brand_baskets(spark, d, 3), 60)
    rows = [t.select(F.lit(k).alias("size"), F.concat_ws(",", *itemsets.names(k)).alias("items"), "n") for k, t in enumerate(found, 1)]
    whole = spark.createDataFrame([], "size int, items string, n long")
    for part in rows:
        whole = whole.unionByName(part)
    return whole


def _freq_two_pass(spark, d):
    found = itemsets.two_pass(_brand_baskets(spark, d), 70, 4)
    return found.select(F.concat_ws(",", "items").alias("items"), "n")


def _members(spark, d):
    return domain.part_reviews(spark, d).select(F.col("item_id").alias("owner"), F.col("user_id").alias("member"))


def _minhash_signatures(spark, d):
    return similarity.signatures(_members(spark, d))


def _lsh_candidates(spark, d):
    return similarity.lsh_candidates(similarity.signatures(_members(spark, d)), 2)


def _lsh_jaccard(spark, d):
    found = similarity.similar_pairs(_members(spark, d), 0.05)
    return found.select("a", "b", F.round("sim", 6).alias("sim"))


def _profiles(spark, d, n):
    """The n heaviest terms of each document by number, and the numbers' names."""
    docs = domain.table(spark, d, "documents")
    numbers = profiles.numbered_terms(docs, "text", domain.stop_words(spark))
    counts = profiles.term_counts(docs, "doc_id", "text", numbers=numbers)
    return profiles.top_terms(profiles.term_weights(counts), n), F.broadcast(numbers)


def _tfidf_top_terms(spark, d):
    top, numbers = _profiles(spark, d, 200)
    return top.join(numbers, "term").select("doc", "rank", F.col("name").alias("term"), F.round("weight", 6).alias("weight"))


def _user_docs(spark, d):
    return domain.part_reviews(spark, d).select(F.col("user_id").alias("user"), F.col("item_id").alias("doc"))


def _user_profiles(spark, d):
    top, numbers = _profiles(spark, d, TOP_TERMS)
    terms = profiles.user_profiles(_user_docs(spark, d), top).join(numbers, "term")
    listed = F.concat_ws(" ", F.array_sort(F.collect_list("name")))
    return terms.groupBy("user").agg(F.count("*").alias("n_terms"), F.md5(listed.cast("binary")).alias("terms_md5"))


def _profile_cosine(spark, d):
    train, test = domain.held_out(domain.part_reviews(spark, d))
    docs = materialize(_profiles(spark, d, TOP_TERMS)[0].select("doc", "term"))
    users = profiles.user_profiles(train.select(F.col("user_id").alias("user"), F.col("item_id").alias("doc")), docs)
    pairs = test.select(F.col("user_id").alias("user"), F.col("item_id").alias("doc")).distinct()
    found = profiles.profile_cosine(pairs, users, docs, 0.01)
    return found.select("user", "doc", F.round("sim", 6).alias("sim"))


def _train_test(spark, d):
    train, test = domain.held_out(domain.supplier_reviews(spark, d))
    return materialize(ratings.mean_ratings(train)), materialize(ratings.mean_ratings(test))


def _item_pearson(spark, d):
    model = ratings.item_model(materialize(ratings.mean_ratings(domain.supplier_reviews(spark, d))))
    return model.select("a", "b", "common", F.round("sim", 6).alias("sim"))


def _user_pearson(spark, d):
    model = ratings.user_model(materialize(ratings.mean_ratings(domain.part_reviews(spark, d))))
    return model.select("a", "b", "common", F.round("sim", 6).alias("sim"))


def _rounded(predictions: DataFrame) -> DataFrame:
    return predictions.select("user_id", "item_id", F.round("pred", 5).alias("pred"))


def _item_cf_predict(spark, d):
    train, test = _train_test(spark, d)
    return _rounded(ratings.predict_by_items(test, train, materialize(ratings.item_model(train))))


def _part_train_test(spark, d):
    train, test = domain.held_out(domain.part_reviews(spark, d))
    return materialize(ratings.mean_ratings(train)), materialize(ratings.mean_ratings(test))


def _user_cf_predict(spark, d):
    train, test = _part_train_test(spark, d)
    return _rounded(ratings.predict_by_users(test, train, materialize(ratings.user_model(train))))


def _business_mean_predict(spark, d):
    train, test = _train_test(spark, d)
    return _rounded(ratings.predict_by_mean(test, train))


def _rmse(spark, d):
    train, test = _train_test(spark, d)
    found = ratings.predict_by_items(test, train, materialize(ratings.item_model(train)))
    scored = ratings.with_fallback(test, found, train)
    return metrics.rmse(scored).select(F.round("rmse", 5).alias("rmse"), "n")


def _cooccur_edges(spark, d):
    return domain.graph(spark, d)


def _graph(spark, d):
    return materialize(domain.graph(spark, d))


def _label_propagation(spark, d):
    return graph.label_propagation(_graph(spark, d))


def _components(spark, d):
    return graph.components(_graph(spark, d))


def _edge_betweenness(spark, d):
    return graph.betweenness(_graph(spark, d)).select("src", "dst", F.round("betweenness", 5).alias("betweenness"))


def _modularity(spark, d):
    edges = _graph(spark, d)
    return graph.modularity(edges, graph.label_propagation(edges)).select(F.round("q", 6).alias("q"))


def _girvan_newman(spark, d):
    return graph.girvan_newman(_graph(spark, d))


def _points(spark, d):
    return materialize(domain.points(spark, d))


def _cluster_stats(spark, d):
    found = clustering.cluster_stats(domain.points(spark, d), "label")
    return found.select("label", "dim", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


def _sigma_outliers(spark, d):
    return clustering.outliers(_points(spark, d))


def _label_summaries(points):
    return {k: clustering.Summary(n, s, q) for k, n, s, q in clustering.vector_sums(points, "label")}


def _mahalanobis_assign(spark, d):
    points = _points(spark, d)
    found = clustering.assign_summaries(points, _label_summaries(points))
    return found.select("id", "cluster", F.round("distance", 5).alias("distance"))


def _kmeans(points):
    start = clustering.first_points(points, KMEANS_K)
    return clustering.assign(points, clustering.kmeans(points, start, KMEANS_ROUNDS, 0.0))


def _kmeans_assign(spark, d):
    return _kmeans(_points(spark, d)).select("id", "cluster", F.round("distance", 5).alias("distance"))


def _davies_bouldin(spark, d):
    return clustering.davies_bouldin(_points(spark, d), "label").select(F.round("db", 5).alias("db"))


def _nmi(spark, d):
    placed = checkpointed(_kmeans(_points(spark, d)).select("label", "cluster"))
    return metrics.nmi(placed, "label", "cluster").select(F.round("nmi", 6).alias("nmi"))


def _bfr(spark, d):
    rounds = clustering.in_rounds(domain.points(spark, d).select("id", "vec"), 2)
    return clustering.cluster_rounds(rounds, 5, alpha=0.98, batch_share=0.34, rounds=5)


def _bfr_rounds(spark, d):
    _, reports = _bfr(spark, d)
    return spark.createDataFrame([tuple(vars(r).values()) for r in reports], ", ".join(f"{n} long" for n in vars(reports[0])))


def _bfr_labels(spark, d):
    return _bfr(spark, d)[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = globals()
    return {name: own[f"_{name}"] for name in NAMES}


NAMES = (
    "category_avg_topk review_count reviews_in_year distinct_users top_users top_words partition_sizes heavy_items "
    "state_user_item freq_items freq_pairs freq_triples freq_itemsets_filtered freq_two_pass minhash_signatures "
    "lsh_candidates lsh_jaccard tfidf_top_terms user_profiles profile_cosine item_pearson user_pearson item_cf_predict "
    "user_cf_predict business_mean_predict rmse cooccur_edges label_propagation components edge_betweenness modularity "
    "girvan_newman cluster_stats sigma_outliers mahalanobis_assign kmeans_assign davies_bouldin nmi bfr_rounds bfr_labels"
).split()


def oracle_sql() -> dict[str, str]:
    return sql.statements()
