"""DuckDB SQL of the named queries, written independently of the operators."""

from __future__ import annotations

from millrace.functions.text import NOISE
from millrace.operators.similarity import HASHES, PRIME, coefficients
from millrace.plans.domain import GRAPH_THRESHOLD, STOP_WORDS, TEST_SHARE

STOPS = ", ".join(f"('{w}')" for w in STOP_WORDS)
STARS = "CAST(1 + (CAST(l_quantity AS INTEGER) - 1) % 5 AS DOUBLE)"


def reviews(item: str) -> str:
    return (
        f"SELECT o_orderkey AS order_id, o_custkey AS user_id, {item} AS item_id, {STARS} AS stars, o_orderdate AS date "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    )


PARTS, SUPPLIERS = reviews("l_partkey"), reviews("l_suppkey")
BASKETS = "SELECT DISTINCT l_orderkey AS b, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey"
LARGE = f"SELECT * FROM ({BASKETS}) WHERE b IN (SELECT b FROM ({BASKETS}) GROUP BY b HAVING count(*) > 3)"


def sets(baskets: str, k: int, support: int) -> str:
    """Itemsets of k items by a k-fold self-join."""
    items = ", ".join(f"t{j}.i AS i{j}" for j in range(1, k + 1))
    joins = "".join(f" JOIN t t{j} ON t{j}.b = t1.b AND t{j}.i > t{j - 1}.i" for j in range(2, k + 1))
    return f"SELECT {items}, count(*) AS n FROM t t1{joins} GROUP BY ALL HAVING count(*) >= {support}"


def joined(k: int) -> str:
    return " || ',' || ".join(f"i{j}" for j in range(1, k + 1))


HASHED = (
    "m AS (SELECT DISTINCT item_id AS owner, user_id AS member FROM r), "
    "c(hash_no, x, y) AS (VALUES " + ", ".join(f"({h}, {a}, {b})" for h, (a, b) in enumerate(coefficients(HASHES))) + "), "
    f"s AS (SELECT owner, hash_no, min((member * x + y) % {PRIME}) AS min_val FROM m, c GROUP BY owner, hash_no)"
)
SIM = """
k AS (SELECT DISTINCT p.owner AS a, q.owner AS b FROM s p JOIN s q ON p.hash_no = q.hash_no AND p.min_val = q.min_val AND p.owner < q.owner),
z AS (SELECT owner, count(*) AS n FROM m GROUP BY owner),
o AS (SELECT a, b, count(*) AS common FROM k JOIN m x ON x.owner = a JOIN m y ON y.owner = b AND y.member = x.member GROUP BY a, b),
j AS (SELECT a, b, common, common / (u.n + v.n - common) AS sim FROM o JOIN z u ON u.owner = a JOIN z v ON v.owner = b)"""

TERMS = f"""
w AS (SELECT doc_id AS doc, unnest(regexp_split_to_array(lower(text), '(?:\\\\[a-zA-Z]|[\\s!-/:-@\\[-`{{-~])+')) AS term FROM documents),
n AS (SELECT doc, term, count(*) AS n FROM w WHERE term <> '' AND NOT regexp_matches(term, '{NOISE}')
  AND term NOT IN (SELECT * FROM (VALUES {STOPS})) GROUP BY doc, term),
f AS (SELECT n.* FROM n JOIN (SELECT term, sum(n) AS t FROM n GROUP BY term) USING (term)
  WHERE t > floor((SELECT sum(n) FROM n) * 1e-6)),
g AS (SELECT term, max(n) AS most, count(*) AS df FROM f GROUP BY term),
v AS (SELECT doc, term, (n / most) * ((SELECT count(DISTINCT doc) FROM f) / df) AS weight FROM f JOIN g USING (term)),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc ORDER BY weight DESC, term) AS INTEGER) AS rank FROM v)"""

MEANS = "SELECT user_id, item_id, avg(stars) AS stars FROM r{} GROUP BY user_id, item_id"
TRAIN = MEANS.format(f" WHERE order_id % {TEST_SHARE} <> 0")
TEST = MEANS.format(f" WHERE order_id % {TEST_SHARE} = 0")


def pearson(rows: str, keep: str) -> str:
    """CTEs that end in ``model`` (a, b, common, sim) from rows (a, b, x, y)."""
    return f"""
sums AS (SELECT a, b, count(*) AS n, sum(x - 3) AS sx, sum(y - 3) AS sy, sum((x - 3) * (x - 3)) AS xx, sum((y - 3) * (y - 3)) AS yy,
  sum((x - 3) * (y - 3)) AS xy FROM ({rows}) GROUP BY a, b HAVING count(*) >= 3),
cov AS (SELECT a, b, n AS common, xx - sx * sx / n AS vx, yy - sy * sy / n AS vy, xy - sx * sy / n AS c FROM sums),
model AS (SELECT a, b, common, CASE WHEN vx > 1e-9 AND vy > 1e-9 THEN c / sqrt(vx * vy) ELSE 0 END AS sim FROM cov
  WHERE round(CASE WHEN vx > 1e-9 AND vy > 1e-9 THEN c / sqrt(vx * vy) ELSE 0 END, 9) {keep})"""


def item_rows(table: str) -> str:
    return f"SELECT p.item_id AS a, q.item_id AS b, p.stars AS x, q.stars AS y FROM {table} p JOIN {table} q ON p.user_id = q.user_id AND p.item_id < q.item_id"


BOTH = "ways AS (SELECT a AS me, b AS other, round(sim, 9) AS sim FROM model UNION ALL SELECT b, a, round(sim, 9) FROM model)"
ITEM_PRED = """
near AS (SELECT t.user_id, t.item_id, e.other, e.sim, p.stars FROM test t JOIN train p ON p.user_id = t.user_id
  JOIN ways e ON e.me = t.item_id AND e.other = p.item_id),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY sim DESC, other) <= 7),
pred AS (SELECT user_id, item_id, sum(sim * stars) / sum(sim) AS pred FROM best GROUP BY user_id, item_id)"""
USER_MODEL = (
    "m AS (SELECT user_id AS owner, item_id AS member FROM {t}), "
    + HASHED.partition("), ")[2]
    + ","
    + SIM
    + ", "
    + pearson(
        "SELECT a, b, p.stars AS x, q.stars AS y FROM j JOIN {t} p ON p.user_id = a JOIN {t} q ON q.user_id = b AND q.item_id = p.item_id "
        "WHERE sim >= 0.01 AND common >= 3",
        ">= 1e-6",
    )
)

GRAPH = (
    f"g AS (SELECT DISTINCT o_custkey AS u, l_partkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    f"e AS (SELECT x.u AS src, y.u AS dst, count(*) AS n FROM g x JOIN g y ON x.p = y.p AND x.u < y.u GROUP BY ALL HAVING count(*) >= {GRAPH_THRESHOLD}), "
    "adj AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"
)
LPA = "l0 AS (SELECT DISTINCT src AS node, src AS label FROM adj)" + "".join(
    f", l{i} AS (SELECT src AS node, label FROM (SELECT src, label, count(*) AS n FROM adj JOIN l{i - 1} ON node = dst GROUP BY src, label) "
    "QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, label) = 1)"
    for i in range(1, 6)
)
LEVELS = 40
PATHS = "p0 AS MATERIALIZED (SELECT DISTINCT src AS root, src AS node, 0 AS dist, 1::DOUBLE AS paths FROM adj)" + "".join(
    f", s{i} AS MATERIALIZED (SELECT root, dst AS node, {i} AS dist, sum(paths) AS paths FROM p{i - 1} JOIN adj ON src = node "
    f"WHERE dist = {i - 1} GROUP BY root, dst), "
    f"p{i} AS MATERIALIZED (SELECT * FROM p{i - 1} UNION ALL SELECT s.* FROM s{i} s ANTI JOIN p{i - 1} p ON p.root = s.root AND p.node = s.node)"
    for i in range(1, LEVELS + 1)
)

POINTS = "p AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
LONG = "x AS (SELECT id, label, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS dim FROM p)"


def spread(group: str) -> str:
    return f"""SELECT {group}, dim, count(*) AS n, sum(v) / count(*) AS mean,
  sqrt(greatest(sum(v * v) / count(*) - (sum(v) / count(*)) * (sum(v) / count(*)), 0)) AS deviation FROM x GROUP BY {group}, dim"""


def kmeans(k: int, rounds: int) -> str:
    """CTEs that end in ``placed`` (id, label, cluster, distance)."""
    out = [POINTS, LONG, f"c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cluster, vec FROM (SELECT * FROM p ORDER BY id LIMIT {k}))"]
    for i in range(rounds + 1):
        out.append(
            f"a{i} AS (SELECT id, label, cluster, list_distance(p.vec, c.vec) AS distance FROM p, c{i} c "
            "QUALIFY row_number() OVER (PARTITION BY id ORDER BY list_distance(p.vec, c.vec), cluster) = 1)"
        )
        if i < rounds:
            out.append(
                f"m{i} AS (SELECT cluster, list(mean ORDER BY dim) AS vec FROM (SELECT cluster, dim, avg(v) AS mean FROM x JOIN a{i} USING (id) GROUP BY ALL) GROUP BY cluster), "
                f"c{i + 1} AS (SELECT c.cluster, coalesce(m.vec, c.vec) AS vec FROM c{i} c LEFT JOIN m{i} m USING (cluster))"
            )
    return ", ".join(out) + f", placed AS (SELECT * FROM a{rounds})"


def statements() -> dict[str, str]:
    found = {
        "category_avg_topk": f"""
WITH r AS ({PARTS}),
c AS (SELECT p_partkey AS item_id, trim(unnest(string_split(concat_ws(', ', p_brand, p_type), ','))) AS category FROM part)
SELECT category, round(avg(stars), 6) AS avg_stars, count(*) AS n FROM r JOIN c USING (item_id)
GROUP BY category ORDER BY avg_stars DESC, category LIMIT 10""",
        "review_count": f"SELECT count(*) AS n FROM ({PARTS})",
        "reviews_in_year": f"SELECT count(*) AS n FROM ({PARTS}) WHERE year(date) = 1997",
        "distinct_users": f"SELECT count(DISTINCT user_id) AS n FROM ({PARTS})",
        "top_users": f"SELECT user_id, count(*) AS n FROM ({PARTS}) GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
        "top_words": f"""
WITH w AS (SELECT unnest(string_split(regexp_replace(lower(text), '[^A-Za-z0-9 ]', ' ', 'g'), ' ')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE word <> '' AND word NOT IN (SELECT * FROM (VALUES {STOPS}))
GROUP BY word ORDER BY n DESC, word LIMIT 20""",
        "heavy_items": f"SELECT item_id, count(*) AS n FROM ({PARTS}) GROUP BY item_id HAVING count(*) > 30",
        "state_user_item": f"""
SELECT user_id, item_id FROM ({SUPPLIERS}) JOIN supplier ON s_suppkey = item_id JOIN nation ON s_nationkey = n_nationkey
WHERE n_name = 'NATION_9'""",
        "freq_items": f"WITH t AS ({BASKETS}) {sets('t', 1, 70)}",
        "freq_pairs": f"WITH t AS ({BASKETS}) {sets('t', 2, 70)}",
        "freq_triples": f"WITH t AS ({BASKETS}) {sets('t', 3, 70)}",
        "freq_itemsets_filtered": f"WITH t AS ({LARGE}) "
        + " UNION ALL ".join(f"SELECT {k} AS size, {joined(k)} AS items, n FROM ({sets('t', k, 60)})" for k in range(1, 6)),
        "freq_two_pass": f"WITH t AS ({BASKETS}) " + " UNION ALL ".join(f"SELECT {joined(k)} AS items, n FROM ({sets('t', k, 70)})" for k in range(1, 4)),
        "minhash_signatures": f"WITH r AS ({PARTS}), {HASHED} SELECT * FROM s",
        "lsh_candidates": f"""
WITH r AS ({PARTS}), {HASHED},
d AS (SELECT x.owner, x.hash_no // 2 AS band, x.min_val AS v, y.min_val AS w FROM s x JOIN s y ON x.owner = y.owner AND y.hash_no = x.hash_no + 1 WHERE x.hash_no % 2 = 0)
SELECT DISTINCT p.owner AS a, q.owner AS b FROM d p JOIN d q ON p.band = q.band AND p.v = q.v AND p.w = q.w AND p.owner < q.owner""",
        "lsh_jaccard": f"WITH r AS ({PARTS}), {HASHED}, {SIM} SELECT a, b, round(sim, 6) AS sim FROM j WHERE sim >= 0.05",
        "tfidf_top_terms": f"WITH {TERMS} SELECT doc, rank, term, round(weight, 6) AS weight FROM k WHERE rank <= 200",
        "user_profiles": f"""
WITH {TERMS}, r AS ({PARTS}), t AS (SELECT DISTINCT user_id AS "user", term FROM r JOIN k ON doc = item_id WHERE rank <= 20)
SELECT "user", count(*) AS n_terms, md5(string_agg(term, ' ' ORDER BY term)) AS terms_md5 FROM t GROUP BY "user" """,
        "profile_cosine": f"""
WITH {TERMS}, r AS ({PARTS}), t AS (SELECT doc, term FROM k WHERE rank <= 20),
u AS (SELECT DISTINCT user_id AS "user", term FROM r JOIN t ON doc = item_id WHERE order_id % {TEST_SHARE} <> 0),
p AS (SELECT DISTINCT user_id AS "user", item_id AS doc FROM r WHERE order_id % {TEST_SHARE} = 0),
c AS (SELECT p."user", p.doc, count(*) AS c FROM p JOIN u ON u."user" = p."user" JOIN t ON t.doc = p.doc AND t.term = u.term GROUP BY ALL),
z AS (SELECT "user", doc, c / (sqrt(CAST(nu AS DOUBLE)) * sqrt(CAST(nd AS DOUBLE))) AS sim FROM c
  JOIN (SELECT "user", count(*) AS nu FROM u GROUP BY "user") USING ("user") JOIN (SELECT doc, count(*) AS nd FROM t GROUP BY doc) USING (doc))
SELECT "user", doc, round(sim, 6) AS sim FROM z WHERE sim >= 0.01""",
        "item_pearson": f"WITH r AS ({SUPPLIERS}), t AS ({MEANS.format('')}), {pearson(item_rows('t'), '> 1e-4')} SELECT a, b, common, round(sim, 6) AS sim FROM model",
        "user_pearson": f"WITH r AS ({PARTS}), t AS ({MEANS.format('')}), {USER_MODEL.format(t='t')} SELECT a, b, common, round(sim, 6) AS sim FROM model",
        "item_cf_predict": f"""
WITH r AS ({SUPPLIERS}), train AS ({TRAIN}), test AS ({TEST}), {pearson(item_rows('train'), '> 1e-4')}, {BOTH}, {ITEM_PRED}
SELECT user_id, item_id, round(pred, 5) AS pred FROM pred""",
        "user_cf_predict": f"""
WITH r AS ({PARTS}), train AS ({TRAIN}), test AS ({TEST}), {USER_MODEL.format(t='train')}, {BOTH},
um AS (SELECT user_id, avg(stars) AS mean FROM train GROUP BY user_id), im AS (SELECT item_id, avg(stars) AS item_mean FROM train GROUP BY item_id),
near AS (SELECT t.user_id, t.item_id, e.other, e.sim, p.stars - um.mean AS d FROM test t JOIN train p ON p.item_id = t.item_id
  JOIN ways e ON e.me = t.user_id AND e.other = p.user_id JOIN um ON um.user_id = p.user_id),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY sim DESC, other) <= 5),
sh AS (SELECT user_id, item_id, sum(sim * d) / sum(abs(sim)) AS shift FROM best GROUP BY user_id, item_id)
SELECT user_id, item_id, round(coalesce(mean + shift, item_mean), 5) AS pred FROM test LEFT JOIN sh USING (user_id, item_id)
LEFT JOIN um USING (user_id) LEFT JOIN im USING (item_id) WHERE coalesce(mean + shift, item_mean) IS NOT NULL""",
        "business_mean_predict": f"""
WITH r AS ({SUPPLIERS}), train AS ({TRAIN}), test AS ({TEST}), im AS (SELECT item_id, avg(stars) AS pred FROM train GROUP BY item_id)
SELECT user_id, item_id, round(pred, 5) AS pred FROM test JOIN im USING (item_id)""",
        "rmse": f"""
WITH r AS ({SUPPLIERS}), train AS ({TRAIN}), test AS ({TEST}), {pearson(item_rows('train'), '> 1e-4')}, {BOTH}, {ITEM_PRED},
im AS (SELECT item_id, avg(stars) AS f FROM train GROUP BY item_id),
z AS (SELECT stars, coalesce(pred, f) AS pred FROM test LEFT JOIN pred USING (user_id, item_id) LEFT JOIN im USING (item_id))
SELECT round(sqrt(avg((pred - stars) * (pred - stars))), 5) AS rmse, count(*) AS n FROM z WHERE pred IS NOT NULL""",
        "cooccur_edges": f"WITH {GRAPH} SELECT * FROM e",
        "partition_sizes": f"WITH r AS ({PARTS}) SELECT CAST(item_id % 8 AS INTEGER) AS partition, count(*) AS n FROM r GROUP BY 1",
        "label_propagation": f"WITH {GRAPH}, {LPA} SELECT node, label FROM l5",
        "components": f"""
WITH RECURSIVE {GRAPH}, v AS (SELECT DISTINCT src AS node, src AS root FROM adj UNION SELECT dst, root FROM v JOIN adj ON src = node)
SELECT node, min(root) AS component FROM v GROUP BY node""",
        "edge_betweenness": f"""
WITH {GRAPH}, {PATHS}, pa AS MATERIALIZED (SELECT * FROM p{LEVELS}),
x AS (SELECT least(a.src, a.dst) AS src, greatest(a.src, a.dst) AS dst, f.paths * l.paths / w.paths AS x
  FROM pa f JOIN adj a ON a.src = f.node JOIN pa w ON w.root = f.root JOIN pa l ON l.root = a.dst AND l.node = w.node
  WHERE f.dist + 1 + l.dist = w.dist)
SELECT src, dst, round(sum(x) / 2, 5) AS betweenness FROM x GROUP BY src, dst""",
        "modularity": f"""
WITH {GRAPH}, {LPA}, k AS (SELECT src AS node, count(*) AS k FROM adj GROUP BY src), m AS (SELECT 2 * count(*) AS m2 FROM e),
c AS (SELECT a.node AS i, b.node AS j FROM l5 a JOIN l5 b ON a.label = b.label AND a.node <> b.node)
SELECT round(sum(((adj.src IS NOT NULL)::INTEGER - x.k * y.k / m2) / m2), 6) AS q FROM c JOIN k x ON x.node = i JOIN k y ON y.node = j
LEFT JOIN adj ON adj.src = i AND adj.dst = j, m""",
        "cluster_stats": f"WITH {POINTS}, {LONG} SELECT label, dim::INTEGER AS dim, n, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM ({spread('label')})",
        "sigma_outliers": f"""
WITH p AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
  QUALIFY row_number() OVER (ORDER BY vec_id) <= floor((SELECT count(*) FROM embeddings) * 0.5)),
{LONG}, s AS ({spread('0 AS g').replace('GROUP BY 0 AS g, dim', 'GROUP BY dim')})
SELECT id, bool_or(abs(v - mean) > 3 * deviation) AS outlier FROM x JOIN s USING (dim) GROUP BY id""",
        "mahalanobis_assign": f"""
WITH {POINTS}, {LONG}, s AS ({spread('label')}),
d AS (SELECT id, s.label AS cluster, sqrt(sum(((v - mean) / deviation) * ((v - mean) / deviation))) AS distance FROM x JOIN s USING (dim)
  WHERE deviation > 0 GROUP BY id, s.label)
SELECT id, cluster, round(distance, 5) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY distance, cluster) = 1""",
        "kmeans_assign": f"WITH {kmeans(5, 3)} SELECT id, cluster::INTEGER AS cluster, round(distance, 5) AS distance FROM placed",
        "davies_bouldin": f"""
WITH {POINTS}, {LONG}, c AS (SELECT label, list(m ORDER BY dim) AS c FROM (SELECT label, dim, avg(v) AS m FROM x GROUP BY ALL) GROUP BY label),
s AS (SELECT label, any_value(c) AS c, avg(list_distance(vec, c)) AS s FROM p JOIN c USING (label) GROUP BY label),
r AS (SELECT a.label, max((a.s + b.s) / list_distance(a.c, b.c)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY a.label)
SELECT round(avg(r), 5) AS db FROM r""",
        "nmi": f"""
WITH {kmeans(5, 3)}, n AS (SELECT label, cluster, count(*) AS n FROM placed GROUP BY ALL), t AS (SELECT sum(n) AS t FROM n),
a AS (SELECT label, sum(n) AS ra FROM n GROUP BY label), b AS (SELECT cluster, sum(n) AS cb FROM n GROUP BY cluster)
SELECT round((SELECT sum(n / t * ln(n * t / (ra * cb))) FROM n JOIN a USING (label) JOIN b USING (cluster), t)
  / (((SELECT -sum(ra / t * ln(ra / t)) FROM a, t) + (SELECT -sum(cb / t * ln(cb / t)) FROM b, t)) / 2), 6) AS nmi""",
    }
    return found
