"""What an operator moves and holds grows no faster than its input."""

import itertools
import math
import random
import re

import pytest

from millrace.functions.vectors import constant
from millrace.operators import graph, itemsets, meetings, profiles, ratings, similarity


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture
def written(monkeypatch):
    """Numbers of rows that the named modules write between steps."""
    counts = []

    def watch(module):
        real = module.materialize

        def materialize(df):
            out = real(df)
            counts.append(out.count())
            return out

        monkeypatch.setattr(module, "materialize", materialize)
        return counts

    return watch


def test_equal_baskets_are_extended_once(spark, written):
    counts = written(itemsets)
    data = [(c * 10 + b, f"i{(b * 3 + j) % 9}") for c in range(30) for b in range(10) for j in range(5)]
    baskets = spark.createDataFrame(data, "basket long, item string")
    groups = {}
    for b, i in data:
        groups.setdefault(b, set()).add(i)
    expected = {}
    for items in groups.values():
        for k in range(1, 6):
            for s in itertools.combinations(sorted(items), k):
                expected[s] = expected.get(s, 0) + 1
    expected = {s: n for s, n in expected.items() if n >= 60}
    assert {tuple(r["items"]): r["n"] for r in itemsets.two_pass(baskets, 60, 2).collect()} == expected
    assert {tuple(r)[:-1]: r["n"] for level in itemsets.frequent_sets(baskets, 60) for r in level.collect()} == expected
    # 10 different baskets of 5 items in 2 parts have 640 subsets, 300 baskets would have 9600
    assert max(counts) <= 640


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


PAIRS_MOVED = re.compile(r"Exchange hashpartitioning\(\w+#\d+L?, \w+#\d+L?, ")


@pytest.fixture(params=[False, True])
def small_parts(monkeypatch, request):
    """Once as it is, once with lists cut into chunks and pairs into parts."""
    if request.param:
        monkeypatch.setattr(meetings, "CHUNK", 3)
        monkeypatch.setattr(meetings, "PAIRS_PER_TASK", 20)


def sets_of(seed, owners=25, of=14, n=7):
    rng = random.Random(seed)
    return {o * 3: {rng.randrange(of) for _ in range(n)} for o in range(owners)}


def test_cooccurrence_moves_lists_not_pairs(spark, small_parts):
    sets = sets_of(11)
    for kind in ("long", "string"):
        name = str if kind == "string" else int
        data = [(name(o), m) for o, s in sets.items() for m in s]
        found = graph.cooccurrence(spark.createDataFrame(data + data[:9], f"u {kind}, p long"), "u", "p", 4)
        assert not PAIRS_MOVED.search(plan(found))
        assert found.schema["src"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
        expected = [(name(min(a, b, key=name)), name(max(a, b, key=name)), len(sets[a] & sets[b])) for a, b in itertools.combinations(sets, 2)]
        assert rows(found) == sorted(x for x in expected if x[2] >= 4)


def test_item_model_moves_lists_not_pairs(spark, small_parts):
    rng = random.Random(4)
    stars = {(u, i): float(rng.randint(1, 5)) for u in range(12) for i in rng.sample(range(9), 6)}
    model = ratings.item_model(spark.createDataFrame([(u, i, s) for (u, i), s in stars.items()], "user_id long, item_id long, stars double"))
    assert not PAIRS_MOVED.search(plan(model))
    expected = {}
    for a, b in itertools.combinations(range(9), 2):
        both = [(stars[u, a], stars[u, b]) for u in range(12) if (u, a) in stars and (u, b) in stars]
        n = len(both)
        if n >= 3:
            mx, my = sum(x for x, _ in both) / n, sum(y for _, y in both) / n
            vx, vy = sum((x - mx) ** 2 for x, _ in both), sum((y - my) ** 2 for _, y in both)
            sim = sum((x - mx) * (y - my) for x, y in both) / math.sqrt(vx * vy) if vx * vy > 1e-9 else 0.0
            if sim > 1e-4:
                expected[a, b] = (n, round(sim, 6))
    assert {(r["a"], r["b"]): (r["common"], round(r["sim"], 6)) for r in model.collect()} == expected


@pytest.mark.parametrize("hashes", [3, 50])
def test_similar_pairs_move_no_candidates(spark, small_parts, hashes):
    sets = sets_of(8)
    frame = spark.createDataFrame([(o, m) for o, s in sets.items() for m in s], "owner long, member long")
    found = similarity.similar_pairs(frame, 0.4, hashes, least_common=3)
    assert "band#" not in plan(found)
    lows = {o: [min((m * a + b) % similarity.PRIME for m in s) for a, b in similarity.coefficients(hashes)] for o, s in sets.items()}
    expected = []
    for a, b in itertools.combinations(sets, 2):
        common, whole = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if common >= 3 and common / whole >= 0.4 and any(x == y for x, y in zip(lows[a], lows[b], strict=True)):
            expected.append((a, b, common, round(common / whole, 9)))
    assert sorted((r["a"], r["b"], r["common"], round(r["sim"], 9)) for r in found.collect()) == expected


def test_minima_meet_only_the_owners_dealt_to_a_task(spark):
    members = spark.range(40).selectExpr("id % 8 owner", "id member")
    text = plan(similarity.signatures(members))
    assert "partial_min" in text and "partial_min" not in text.rsplit("Exchange", 1)[1]


def test_user_predictions_are_the_same_in_either_order(spark, monkeypatch):
    rng = random.Random(6)
    frame = spark.createDataFrame([(u, i, float(rng.randint(1, 5))) for u in range(9) for i in rng.sample(range(8), 5)], "user_id long, item_id long, stars double")
    pairs = spark.createDataFrame([(u, i) for u in range(10) for i in range(9)], "user_id long, item_id long")
    model = spark.createDataFrame([(a, b, 3, 0.1 * (a + b)) for a in range(4) for b in range(a + 1, 6)], "a long, b long, common long, sim double")
    found = []
    for smaller in ("user_id", "item_id"):
        monkeypatch.setattr(ratings, "_meeting", lambda left, right, key, smaller=smaller: 0 if key == smaller else 1)
        found.append([(r["user_id"], r["item_id"], round(r["pred"], 9)) for r in sorted(ratings.predict_by_users(pairs, frame, model).collect())])
    assert found[0] == found[1] and found[0]


def test_user_profiles_move_lists_of_terms(spark):
    pairs = [(u, d) for u in range(6) for d in range(u, u + 4)] + [(0, 1)]
    terms = [(d, (d * 5 + j) % 11) for d in range(8) for j in range(4)]
    users = profiles.user_profiles(spark.createDataFrame(pairs, "user long, doc long"), spark.createDataFrame(terms, "doc long, term int"))
    assert not re.search(r"Exchange hashpartitioning\(user#\d+L?, term#", plan(users))
    expected = {(u, t) for u, d in pairs for e, t in terms if d == e}
    assert rows(users) == sorted(expected)
    docs = spark.createDataFrame(terms, "doc long, term int")
    asked = spark.createDataFrame([(0, 0), (5, 1), (9, 0)], "user long, doc long")
    found = profiles.profile_cosine(asked, users, docs, 0.01)
    assert not re.search(r"hashpartitioning\(doc#\d+L?, term#", plan(found))
    mine = {u: {t for v, t in expected if v == u} for u in range(6)}
    held = {d: {t for e, t in terms if e == d} for d in range(8)}
    scores = [(u, d, round(len(mine[u] & held[d]) / math.sqrt(len(mine[u]) * len(held[d])), 9)) for u, d in ((0, 0), (5, 1)) if mine[u] & held[d]]
    assert [(u, d, round(s, 9)) for u, d, s in rows(found)] == sorted(scores)


def test_terms_have_a_bound_and_are_sent_to_every_task(spark):
    docs = spark.createDataFrame([(1, "ab cd cd 7 x"), (2, "cd ef"), (2, "ef the")], "doc long, text string")
    stop = spark.createDataFrame([("the",)], "word string")
    counts = profiles.term_counts(docs, "doc", "text", stop)
    assert rows(counts) == [(1, "ab", 1), (1, "cd", 2), (2, "cd", 1), (2, "ef", 2)]
    numbers = profiles.numbered_terms(docs, "text", stop)
    assert rows(numbers) == [("ab", 0), ("cd", 1), ("ef", 2)]
    assert rows(profiles.term_counts(docs, "doc", "text", numbers=numbers)) == [(1, 0, 1), (1, 1, 2), (2, 1, 1), (2, 2, 2)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in plan(profiles.term_weights(counts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_constant_vectors_are_one_literal_and_exact(spark):
    values = [0.1, -1e-300, 1 / 3, 5e300, 0.0, float("inf"), 2.0**-1074]
    column = constant(values)
    assert spark.range(1).select(column.alias("v")).first()["v"] == values
    assert "array(" not in str(column)
    assert spark.range(1).select(constant([]).alias("v")).first()["v"] == []
