"""Edge cases and properties of the mining operators on small inputs."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import content_words, listed
from millrace.operators import clustering, graph, itemsets, metrics, partitions, profiles, ratings, relational, similarity
from millrace.operators.components import connected_components
from millrace.sources import readers, reports


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_listed_categories(spark):
    one = spark.createDataFrame([(" a , b，c ",)], "t string").select(listed(F.col("t"))).first()[0]
    assert one == ["a", "b", "c"]


def test_content_words_drop_backslash_letters(spark):
    one = spark.createDataFrame([("It's\\n 42 x good-bye",)], "t string").select(content_words(F.col("t"))).first()[0]
    assert one == ["it", "s", "42", "x", "good", "bye"]


def test_top_categories_ignore_null_lists_and_break_ties(spark):
    reviews = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0)], "item_id long, stars double")
    shops = spark.createDataFrame([(1, "b"), (2, "a, b"), (3, None)], "item_id long, categories string")
    assert [tuple(r) for r in relational.top_categories(reviews, shops, 5).collect()] == [("a", 5.0, 1), ("b", 5.0, 2)]


def test_no_review_in_year_counts_zero(spark):
    reviews = spark.createDataFrame([("2016-01-01 10:00:00",)], "date string")
    assert relational.row_count(relational.in_year(reviews, "2017")).first()["n"] == 0


def test_top_by_count_ties(spark):
    table = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "k string")
    assert [r["k"] for r in relational.top_by_count(table, "k", 2).collect()] == ["a", "b"]


def test_partitioning_does_not_change_heavy_keys(spark):
    table = spark.range(100).select((F.col("id") % 7).alias("k"))
    assert rows(partitions.heavy_keys(table, "k", 14)) == rows(partitions.heavy_keys(table.repartition(3, "k"), "k", 14))
    assert sum(r["n"] for r in partitions.partition_sizes(table, 3, "k").collect()) == 100


def random_baskets(spark, seed=3):
    rng = random.Random(seed)
    data = {(b, f"i{int(rng.triangular(0, 9, 2))}") for b in range(60) for _ in range(5)}
    return spark.createDataFrame(sorted(data), "basket long, item string"), data


def test_frequent_sets_equal_enumeration_and_library(spark):
    from pyspark.ml.fpm import FPGrowth

    frame, data = random_baskets(spark)
    groups = {}
    for b, i in data:
        groups.setdefault(b, set()).add(i)
    support = 12
    expected = {}
    for items in groups.values():
        for k in range(1, len(items) + 1):
            for s in itertools.combinations(sorted(items), k):
                expected[s] = expected.get(s, 0) + 1
    expected = {s: n for s, n in expected.items() if n >= support}
    for hashed in (False, True):
        found = {}
        for level in itemsets.frequent_sets(frame, support, hash_pairs=hashed):
            found |= {tuple(r[:-1]): r[-1] for r in level.collect()}
        assert found == expected
    wide = frame.groupBy("basket").agg(F.collect_list("item").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=(support - 0.5) / len(groups)).fit(wide)
    assert {tuple(sorted(r["items"])): r["freq"] for r in model.freqItemsets.collect()} == expected
    two = {tuple(r["items"]): r["n"] for r in itemsets.two_pass(frame, support, 3, 4).collect()}
    assert two == {s: n for s, n in expected.items() if len(s) <= 4}


def test_no_frequent_item_gives_no_level(spark):
    frame, _ = random_baskets(spark)
    assert itemsets.frequent_sets(frame, 1000) == []


def test_dense_index_numbers_in_order(spark):
    values = spark.createDataFrame([(x,) for x in ["b", "a", "c", "a", None]], "v string")
    assert rows(similarity.dense_index(values, "v")) == [("a", 0), ("b", 1), ("c", 2)]


def test_similar_pairs_are_exact(spark):
    rng = random.Random(1)
    sets = {o: {rng.randrange(12) for _ in range(6)} for o in range(12)}
    frame = spark.createDataFrame([(o, m) for o, s in sets.items() for m in s], "owner long, member long")
    for r in similarity.similar_pairs(frame, 0.5).collect():
        a, b = sets[r["a"]], sets[r["b"]]
        assert r["a"] < r["b"] and math.isclose(r["sim"], len(a & b) / len(a | b)) and r["sim"] >= 0.5


def test_missing_profile_scores_zero(spark):
    pairs = spark.createDataFrame([("u", 1), ("v", 1)], "user string, doc long")
    users = spark.createDataFrame([("u", "x"), ("u", "y")], "user string, term string")
    docs = spark.createDataFrame([(1, "x")], "doc long, term string")
    assert rows(profiles.profile_cosine(pairs, users, docs, 0)) == [("u", 1, 1 / math.sqrt(2)), ("v", 1, 0.0)]


def test_pearson_needs_three_common_and_spread(spark):
    data = [(u, i, float(s)) for i, stars in {1: (1, 3, 5), 2: (2, 3, 4), 3: (4, 4, 4), 4: (1, 5, None)}.items() for u, s in enumerate(stars) if s]
    model = ratings.item_model(spark.createDataFrame(data, "user_id long, item_id long, stars double"))
    assert [(r["a"], r["b"], r["common"], round(r["sim"], 9)) for r in model.collect()] == [(1, 2, 3, 1.0)]


def test_predictions_fall_back(spark):
    train = spark.createDataFrame([(1, 1, 4.0), (2, 1, 2.0), (1, 2, 5.0)], "user_id long, item_id long, stars double")
    test = spark.createDataFrame([(2, 2, 4.0), (3, 1, 3.0), (3, 9, 1.0)], "user_id long, item_id long, stars double")
    model = spark.createDataFrame([(1, 2, 3, 0.5)], "a long, b long, common long, sim double")
    found = ratings.predict_by_items(test, train, model)
    assert rows(found) == [(2, 2, 2.0)]
    whole = ratings.with_fallback(test, found, train)
    assert sorted((r["user_id"], r["item_id"], r["pred"]) for r in whole.collect()) == [(2, 2, 2.0), (3, 1, 3.0)]
    assert metrics.rmse(whole).first()["rmse"] == pytest.approx(math.sqrt(2))


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_components_of_chains_loops_and_nothing(spark):
    chain = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)]
    found = dict(rows(connected_components(edges_of(spark, chain))))
    assert found == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 40: 40}
    assert rows(connected_components(edges_of(spark, []))) == []


def random_graph(seed, n=14, p=0.22):
    rng = random.Random(seed)
    return [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < p]


def test_betweenness_forms_agree_and_sum_to_distances(spark):
    pairs = random_graph(2)
    edges = edges_of(spark, pairs)
    fast = {(r["src"], r["dst"]): r["betweenness"] for r in graph.betweenness(edges).collect()}
    slow = {(r["src"], r["dst"]): r["betweenness"] for r in graph.betweenness_by_joins(edges).collect()}
    assert fast.keys() == slow.keys() == set(pairs)
    assert all(math.isclose(fast[e], slow[e], abs_tol=1e-9) for e in pairs)
    distances = graph.shortest_paths(edges).where("root < node").agg(F.sum("dist")).first()[0]
    assert math.isclose(sum(fast.values()), distances)


def plain_modularity(pairs, label):
    m2 = 2 * len(pairs)
    degree = {}
    for a, b in pairs:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    linked = {frozenset(e) for e in pairs}
    return sum(
        (int(frozenset((a, b)) in linked) - degree[a] * degree[b] / m2) / m2
        for a in degree for b in degree if a != b and label[a] == label[b]
    )


def test_modularity_and_singletons(spark):
    pairs = random_graph(4)
    edges = edges_of(spark, pairs)
    nodes = {x for e in pairs for x in e}
    label = {v: v % 3 for v in nodes}
    frame = spark.createDataFrame(sorted(label.items()), "node long, label long")
    assert graph.modularity(edges, frame).first()["q"] == pytest.approx(plain_modularity(pairs, label))
    alone = spark.createDataFrame([(v, v) for v in nodes], "node long, label long")
    assert graph.modularity(edges, alone).first()["q"] == 0


def test_girvan_newman_equals_plain_loop(spark):
    pairs = random_graph(5, 9, 0.3) + [(20, 21), (21, 22), (20, 22), (22, 23), (23, 24), (24, 25), (23, 25)]

    def groups(live):
        parent = {x: x for e in pairs for x in e}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in live:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in parent}

    live, best = list(pairs), None
    while True:
        label = groups(live)
        q = round(plain_modularity(pairs, label), 10)
        if best is None or q > best[0]:
            best = (q, label)
        if not live:
            break
        near = graph._neighbours(live)
        total = {}
        for root in sorted(near):
            for e, x in graph._flow(near, root).items():
                total[e] = total.get(e, 0) + x / 2
        top = max(total.values())
        cut = min(e for e, x in total.items() if x > top - 1e-8)
        live.remove(cut)
    found = dict(rows(graph.girvan_newman(edges_of(spark, pairs))))
    assert round(plain_modularity(pairs, found), 9) == pytest.approx(best[0], abs=1e-9)


def test_label_propagation_labels_are_nodes(spark):
    pairs = random_graph(7)
    found = dict(rows(graph.label_propagation(edges_of(spark, pairs))))
    assert set(found.values()) <= set(found)


def blobs(spark, n=60):
    rng = random.Random(9)
    data = [(i, [10.0 * (i % 3) + rng.gauss(0, 0.5), 5.0 * (i % 3) + rng.gauss(0, 0.5)], i % 3) for i in range(n)]
    return spark.createDataFrame(data, "id long, vec array<double>, label int")


def test_kmeans_recovers_blobs(spark):
    points = blobs(spark)
    placed = clustering.assign(points, clustering.kmeans(points, clustering.far_points(points, 3)))
    assert metrics.nmi(placed, "label", "cluster").first()["nmi"] == pytest.approx(1.0)
    assert metrics.nmi(placed, "label", "label").first()["nmi"] == pytest.approx(1.0)


def test_rounds_recover_blobs_and_label_every_point(spark):
    points = blobs(spark)
    labels, reports_ = clustering.cluster_rounds(clustering.in_rounds(points.select("id", "vec"), 2), 3, batch_share=0.5)
    assert labels.count() == labels.select("id").distinct().count() == 60
    assert len(reports_) == 2
    joined = points.join(labels, "id").where("cluster >= 0")
    assert metrics.nmi(joined, "label", "cluster").first()["nmi"] > 0.9


def test_merged_summaries_equal_the_union():
    import numpy as np

    x, y = np.random.default_rng(1).normal(size=(5, 3)), np.random.default_rng(2).normal(size=(7, 3))
    one = [clustering.Summary(len(z), z.sum(0), (z**2).sum(0)) for z in (x, y, np.vstack([x, y]))]
    both = one[0].merged(one[1])
    assert both.n == one[2].n and np.allclose(both.centre, one[2].centre) and np.allclose(both.deviation, one[2].deviation)


def test_flat_dimension_is_left_out():
    import numpy as np

    s = clustering.Summary(2, np.array([2.0, 2.0]), np.array([2.0, 10.0]))
    assert s.distance(np.array([5.0, 1.0])) == pytest.approx(0.0)


def test_readers_and_reports(spark, tmp_path):
    (tmp_path / "pairs.csv").write_text("user_id,business_id\nu1,b1\nuser_id,business_id\nu2,b1\n")
    assert rows(readers.pairs(spark, str(tmp_path / "pairs.csv"))) == [("u1", "b1"), ("u2", "b1")]
    folder = tmp_path / "points"
    folder.mkdir()
    (folder / "b.txt").write_text("2,0.5,1.5\n")
    (folder / "a.txt").write_text("1,1.0,2.0\n\n")
    (folder / ".hidden").write_text("x")
    paths = readers.round_paths(spark, str(folder))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.txt", "b.txt"]
    assert [tuple(r) for r in readers.points(spark, paths[0]).collect()] == [(1, [1.0, 2.0])]
    (tmp_path / "map.json").write_text('{"a": 1, "b": 2.5}')
    assert rows(readers.number_map(spark, str(tmp_path / "map.json"))) == [("a", 1.0), ("b", 2.5)]
    reports.itemsets(str(tmp_path / "out.txt"), [], [("b",), ("a",), ("a", "b")])
    assert (tmp_path / "out.txt").read_text() == "Candidates:\n\n\nFrequent Itemsets:\n('a'),('b')\n\n('a', 'b')\n"
    labels = spark.createDataFrame([(2, -1), (1, 0)], "id long, cluster int")
    reports.cluster_map(str(tmp_path / "c.json"), labels)
    assert json.loads((tmp_path / "c.json").read_text()) == {"1": 0, "2": -1}
    groups = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "node string, community long")
    reports.communities(str(tmp_path / "g.txt"), groups)
    assert (tmp_path / "g.txt").read_text() == "'c'\n'a', 'b'\n"


def test_stream_of_files_feeds_the_clusterer(spark, tmp_path):
    from millrace.streaming.rounds import cluster_stream, point_stream

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(2):
        text = "".join(f"{k * 30 + i},{10.0 * (i % 3) + i * 0.01},{5.0 * (i % 3)}\n" for i in range(30))
        (folder / f"{k}.txt").write_text(text)
    clusterer = clustering.SummarisingClusterer(3, batch_share=0.5, rounds=3)
    cluster_stream(point_stream(spark, str(folder)), clusterer, str(tmp_path / "cp")).awaitTermination()
    assert len(clusterer.reports) == 2 and clusterer.finish().count() == 60


def test_two_pass_finds_sets_of_any_size(spark):
    rows = [(b, i) for b in range(40) for i in "abcde"] + [(b, "f") for b in range(20)]
    baskets = spark.createDataFrame(rows, "basket long, item string")
    found = {tuple(r["items"]): r["n"] for r in itemsets.two_pass(baskets, 30, 4).collect()}
    assert found == {c: 40 for k in range(1, 6) for c in itertools.combinations("abcde", k)}
