"""Whole jobs from input files to reports, with ids of letters."""

import csv
import json
import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from millrace import jobs
from millrace.operators import clustering, graph, profiles, ratings


def write_json(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def read_rows(folder):
    return [json.loads(line) for f in sorted(folder.glob("part-*")) for line in f.read_text().splitlines()]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = random.Random(17)
    base = tmp_path_factory.mktemp("jobs")
    users, shops = [f"u{chr(97 + i)}" for i in range(14)], [f"shop-{chr(97 + i)}" for i in range(9)]
    bags = {s: [f"{s[-1]}word{k}" for k in range(6)] + ["common", "the"] for s in shops}
    reviews = []
    for u in users:
        for s in rng.sample(shops, 6):
            text = " ".join(rng.choices(bags[s], k=12))
            reviews.append({"review_id": f"{u}{s}", "user_id": u, "business_id": s, "stars": float(rng.randrange(1, 6)), "text": text, "date": f"201{rng.randrange(6, 9)}-01-02 03:04:05"})
    shop_rows = [
        {"business_id": s, "name": s, "state": "NV" if i % 2 else "AZ", "categories": None if i == 0 else "Food, Tea" if i % 3 else "Tea"}
        for i, s in enumerate(shops)
    ]
    (base / "stop").write_text("the\n")
    with open(base / "pairs.csv", "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(["user_id", "business_id"])
        out.writerows((r["user_id"], r["business_id"]) for r in reviews)
    return {
        "dir": base, "reviews": write_json(base / "reviews.json", reviews), "shops": write_json(base / "shops.json", shop_rows),
        "stop": str(base / "stop"), "pairs": str(base / "pairs.csv"), "rows": reviews, "shop_rows": shop_rows,
    }


def test_exploration_ranking_and_partitions(spark, files, tmp_path):
    rows = files["rows"]
    jobs.explore(spark, files["reviews"], str(tmp_path / "a"), files["stop"], "2017", 3, 4)
    found = json.loads((tmp_path / "a").read_text())
    active = sorted(Counter(r["user_id"] for r in rows).items(), key=lambda x: (-x[1], x[0]))[:3]
    words = Counter(w for r in rows for w in r["text"].split() if w != "the")
    assert found == {
        "A": len(rows), "B": sum(r["date"].startswith("2017") for r in rows), "C": len({r["user_id"] for r in rows}),
        "D": [list(x) for x in active], "E": sorted(words, key=lambda w: (-words[w], w))[:4],
    }
    jobs.rank_categories(spark, files["reviews"], files["shops"], str(tmp_path / "b"), 5)
    lists = {s["business_id"]: (s["categories"] or "").split(", ") for s in files["shop_rows"] if s["categories"]}
    stars = defaultdict(list)
    for r in rows:
        for c in lists.get(r["business_id"], []):
            stars[c].append(r["stars"])
    means = sorted(((c, sum(v) / len(v)) for c, v in stars.items()), key=lambda x: (-x[1], x[0]))
    assert [(c, pytest.approx(m, abs=1e-6)) for c, m in means] == [tuple(x) for x in json.loads((tmp_path / "b").read_text())["result"]]
    jobs.report_partitions(spark, files["reviews"], str(tmp_path / "c"), 9, 3)
    report = json.loads((tmp_path / "c").read_text())
    counts = Counter(r["business_id"] for r in rows)
    assert report["n_partitions"] == 3 and sum(report["n_items"]) == len(rows)
    assert report["result"] == [[s, n] for s, n in sorted(counts.items()) if n > 9]
    jobs.pairs_of_state(spark, files["reviews"], files["shops"], str(tmp_path / "d"))
    lines = [line for f in (tmp_path / "d").glob("part-*") for line in f.read_text().splitlines()]
    nevada = {s["business_id"] for s in files["shop_rows"] if s["state"] == "NV"}
    assert sorted(x for x in lines if x != "user_id,business_id") == sorted(f"{r['user_id']},{r['business_id']}" for r in rows if r["business_id"] in nevada)


def test_itemsets_of_any_size(spark, files, tmp_path):
    baskets = defaultdict(set)
    for r in files["rows"]:
        baskets[r["user_id"]].add(r["business_id"])
    items = sorted({s for b in baskets.values() for s in b})
    expected = [c for k in range(1, 7) for c in combinations(items, k) if sum(set(c) <= b for b in baskets.values()) >= 3]
    assert max(map(len, expected)) >= 4
    jobs.mine_itemsets(spark, files["pairs"], str(tmp_path / "s"), 3)
    text = (tmp_path / "s").read_text()
    listed = text.split("Frequent Itemsets:\n")[1]
    lines = [",".join("(" + ", ".join(f"'{x}'" for x in c) + ")" for c in expected if len(c) == k) for k in range(1, max(map(len, expected)) + 1)]
    assert listed == "\n\n".join(lines) + "\n" and text.startswith("Candidates:\n")


def test_models_go_through_files_to_predictions(spark, files, tmp_path):
    path = lambda n: str(tmp_path / n)
    pairs = [{"user_id": r["user_id"], "business_id": s["business_id"]} for r in files["rows"][::7] for s in files["shop_rows"]]
    test = write_json(tmp_path / "test.json", pairs)
    raters = defaultdict(set)
    for r in files["rows"]:
        raters[r["business_id"]].add(r["user_id"])
    jobs.similar_businesses(spark, files["reviews"], path("sim"), 0.3)
    exact = {(a, b): len(raters[a] & raters[b]) / len(raters[a] | raters[b]) for a, b in combinations(sorted(raters), 2)}
    assert {(r["b1"], r["b2"]): pytest.approx(r["sim"]) for r in read_rows(tmp_path / "sim")} == {k: v for k, v in exact.items() if v >= 0.3}
    jobs.train_profiles(spark, files["reviews"], path("prof"), files["stop"], 4)
    model = read_rows(tmp_path / "prof")
    content = {(r["profile_type"], r["profile_id"]): set(r["profile_content"]) for r in model}
    assert {k for k, _ in content} == {"user", "business"} and all(len(v) <= 4 for (k, _), v in content.items() if k == "business")
    jobs.predict_by_profiles(spark, test, path("prof"), path("cos"))
    for r in read_rows(tmp_path / "cos"):
        u, d = content["user", r["user_id"]], content["business", r["business_id"]]
        assert r["sim"] == pytest.approx(len(u & d) / math.sqrt(len(u) * len(d)))
    truth = {(r["user_id"], r["business_id"]): r["stars"] for r in files["rows"]}
    averages = tmp_path / "avg.json"
    for kind, names in (("item_based", ("b1", "b2")), ("user_based", ("u1", "u2"))):
        jobs.train_similarities(spark, files["reviews"], path(kind), kind)
        rows = read_rows(tmp_path / kind)
        assert rows and all(set(r) == {*names, "sim"} and r[names[0]] < r[names[1]] for r in rows)
        table = jobs._ratings(spark, files["reviews"])
        direct = ratings.item_model(table) if kind == "item_based" else ratings.user_model(table)
        assert {(r[names[0]], r[names[1]]): pytest.approx(r["sim"]) for r in rows} == {(r["a"], r["b"]): r["sim"] for r in direct.collect()}
        jobs.predict_ratings(spark, files["reviews"], test, path(kind), path(kind + "-out"), kind)
        found = {(r["user_id"], r["business_id"]): r["stars"] for r in read_rows(tmp_path / (kind + "-out"))}
        assert found and set(found) <= {(p["user_id"], p["business_id"]) for p in pairs}
        averages.write_text(json.dumps({"UNK": 3.0}))
        error = jobs.rating_error(spark, files["reviews"], path(kind + "-out"), str(averages), kind)
        assert error == pytest.approx(math.sqrt(sum((found.get(k, 3.0) - v) ** 2 for k, v in truth.items()) / len(truth)))


def test_communities_of_letters(spark, files, tmp_path):
    jobs.find_communities(spark, 4, files["pairs"], str(tmp_path / "lpa"))
    jobs.cut_communities(spark, 4, files["pairs"], str(tmp_path / "edges"), str(tmp_path / "gn"))
    edges = jobs._graph(spark, files["pairs"], 4)
    near = defaultdict(set)
    for r in edges.collect():
        near[r["src"]].add(r["dst"])
        near[r["dst"]].add(r["src"])
    label = {n: n for n in near}
    for _ in range(5):
        votes = {n: Counter(label[m] for m in near[n]) for n in near}
        label = {n: min(v, key=lambda x: (-v[x], x)) for n, v in votes.items()}
    assert {r["node"]: r["label"] for r in graph.label_propagation(edges).collect()} == label
    members = sorted((sorted(n for n in near if label[n] == x) for x in set(label.values())), key=lambda m: (len(m), m[0]))
    assert (tmp_path / "lpa").read_text().splitlines() == [", ".join(f"'{n}'" for n in m) for m in members]
    values = [float(line.rsplit(", ", 1)[1]) for line in (tmp_path / "edges").read_text().splitlines()]
    assert values == sorted(values, reverse=True) and len(values) == edges.count()
    assert sorted(x for line in (tmp_path / "gn").read_text().splitlines() for x in line.replace("'", "").split(", ")) == sorted(near)


def test_folder_of_points(spark, tmp_path):
    rng = random.Random(4)
    (tmp_path / "in").mkdir()
    truth = {}
    for f in range(2):
        lines = []
        for i in range(150):
            k = i % 3
            truth[f * 150 + i] = k
            lines.append(f"{f * 150 + i},{rng.gauss(40 * k, 1)},{rng.gauss(-30 * k, 1)}")
        (tmp_path / "in" / f"data{f}.txt").write_text("\n".join(lines) + "\n")
    jobs.cluster_folder(spark, str(tmp_path / "in"), 3, str(tmp_path / "out"), str(tmp_path / "rounds"))
    (tmp_path / "truth").write_text(json.dumps({str(i): k for i, k in truth.items()}))
    assert jobs.compare_clusters(spark, str(tmp_path / "truth"), str(tmp_path / "out")) > 0.9
    rounds = list(csv.DictReader((tmp_path / "rounds").open()))
    assert [r["round_id"] for r in rounds] == ["1", "2"]
    assert sum(int(rounds[-1][c]) for c in ("nof_point_discard", "nof_point_compression", "nof_point_retained")) == 300


def test_an_empty_cluster_is_infinitely_bad(spark):
    points = spark.createDataFrame([(i, [float(i), 0.0], i // 5) for i in range(10)], "id long, vec array<double>, cluster long")
    plain = clustering.davies_bouldin(points).first()["db"]
    assert plain == pytest.approx((1.2 + 1.2) / 5.0)
    assert clustering.davies_bouldin(points, clusters=2).first()["db"] == plain
    assert clustering.davies_bouldin(points, clusters=3).first()["db"] == float("inf")
    assert clustering.davies_bouldin(points.withColumn("cluster", F.lit(1).cast("long"))).first()["db"] is None


def test_best_of_several_starts(spark):
    rng = random.Random(1)
    points = spark.createDataFrame([(i, [20.0 * (i % 3) + rng.random(), rng.random()]) for i in range(60)], "id long, vec array<double>")
    good = [(k, [20.0 * k, 0.0]) for k in range(3)]
    bad = [(0, [0.0, 0.0]), (1, [500.0, 0.0]), (2, [900.0, 0.0])]
    assert sorted(round(c[0] / 20) for _, c in clustering.best_kmeans(points, [bad, good])) == [0, 1, 2]


def test_rare_words_go_beyond_a_million(spark):
    table = spark.range(2_100_000).select(
        F.when(F.col("id") < 2, "lone").when(F.col("id") < 5, "thrice").otherwise("often").alias("text"), (F.col("id") % 3).alias("doc")
    )
    kept = profiles.term_counts(table, "doc", "text", spark.createDataFrame([], "word string"))
    assert {r["term"] for r in kept.select("term").distinct().collect()} == {"thrice", "often"}
