"""Co-occurrence graphs: label propagation, betweenness, communities.

Graphs are frames: ``edges`` (src, dst) with src < dst, each once, and
``vertices`` (node).
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import connected_components
from millrace.operators.meetings import meeting_counts
from millrace.scratch import checkpointed, materialize

#: Edges that are sent to every task of the per-source search, at most.
MAX_SHIPPED_EDGES = 500_000
TIE = 1e-8


def cooccurrence(pairs: DataFrame, member: str, group: str, at_least: int) -> DataFrame:
    """(src, dst, n): members that share ``at_least`` groups."""
    counted = meeting_counts(pairs, member, group, at_least, distinct=True)
    return counted.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("common").alias("n"))


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label): every node takes, in each round at once, the label most
    frequent among its neighbours, the smallest of several. Nodes may be of any
    kind that has an order."""
    near = materialize(adjacency(edges))
    labels = vertices_of(edges).withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = near.join(labels, near["dst"] == labels["node"]).groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("few"), "label")).alias("m"))
        labels = checkpointed(best.select(F.col("src").alias("node"), "m.label"))
    return labels


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the component being its smallest node."""
    return connected_components(edges)


def shortest_paths(edges: DataFrame) -> DataFrame:
    """(root, node, dist, paths): distance and number of shortest paths from
    every node to every node it reaches, level by level."""
    near = materialize(adjacency(edges))
    level = vertices_of(edges).select(F.col("node").alias("root"), "node", F.lit(0).alias("dist"), F.lit(1).cast("long").alias("paths"))
    level = materialize(level)
    seen = level
    dist = 0
    while not level.isEmpty():
        dist += 1
        step = level.join(near, level["node"] == near["src"]).groupBy("root", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        fresh = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        level = materialize(fresh.select("root", "node", F.lit(dist).alias("dist"), "paths"))
        seen = seen.unionByName(level)
    return seen


def betweenness_by_joins(edges: DataFrame) -> DataFrame:
    """(src, dst, betweenness) from all shortest paths: of the paths from s to t
    the edge (u, v) carries paths(s, u) * paths(v, t) / paths(s, t) where the
    distances add up. Every unordered pair of ends counts once."""
    paths = materialize(shortest_paths(edges))
    ends = paths.where("root <> node").select(F.col("root").alias("s"), F.col("node").alias("t"), F.col("dist").alias("d"), F.col("paths").alias("p"))
    to_u = paths.select(F.col("root").alias("s"), F.col("node").alias("u"), F.col("dist").alias("du"), F.col("paths").alias("pu"))
    from_v = paths.select(F.col("node").alias("t"), F.col("root").alias("v"), F.col("dist").alias("dv"), F.col("paths").alias("pv"))
    steps = to_u.join(adjacency(edges).select(F.col("src").alias("u"), F.col("dst").alias("v")), "u")
    used = steps.join(from_v, "v").join(ends, ["s", "t"]).where("du + 1 + dv = d")
    carried = used.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), (F.col("pu") * F.col("pv") / F.col("p")).alias("x"))
    return carried.groupBy("src", "dst").agg((F.sum("x") / 2).alias("betweenness"))


def betweenness(edges: DataFrame, tasks: int = 32) -> DataFrame:
    """(src, dst, betweenness). While the edges are few enough to be sent to
    every task, each task searches from its share of the roots; beyond that the
    relational form is used."""
    listed = edges.select("src", "dst").limit(MAX_SHIPPED_EDGES + 1).collect()
    if len(listed) > MAX_SHIPPED_EDGES:
        return betweenness_by_joins(edges)
    near = _neighbours([(r["src"], r["dst"]) for r in listed])
    roots = vertices_of(edges).select("node", F.pmod(F.xxhash64("node"), F.lit(tasks)).alias("share"))
    kind = edges.schema["src"].dataType.simpleString()

    def credit(share: pd.DataFrame) -> pd.DataFrame:
        total: dict = defaultdict(float)
        for root in sorted(share["node"]):
            for edge, x in _flow(near, root).items():
                total[edge] += x
        return pd.DataFrame([(a, b, x) for (a, b), x in total.items()], columns=["src", "dst", "x"])

    parts = roots.groupBy("share").applyInPandas(credit, f"src {kind}, dst {kind}, x double")
    return parts.groupBy("src", "dst").agg((F.sum("x") / 2).alias("betweenness"))


def _neighbours(edges: list[tuple]) -> dict:
    near: dict = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    return dict(near)


def _flow(near: dict, root) -> dict:
    """Credit of every edge for the shortest paths that start at ``root``."""
    dist, paths, order = {root: 0}, {root: 1.0}, [root]
    queue = deque(order)
    while queue:
        u = queue.popleft()
        for v in near[u]:
            if v not in dist:
                dist[v], paths[v] = dist[u] + 1, 0.0
                order.append(v)
                queue.append(v)
            if dist[v] == dist[u] + 1:
                paths[v] += paths[u]
    credit, flow = dict.fromkeys(order, 1.0), {}
    for v in reversed(order):
        for u in near[v]:
            if dist[u] == dist[v] - 1:
                x = credit[v] * paths[u] / paths[v]
                credit[u] += x
                flow[(u, v) if u < v else (v, u)] = x
    return flow


def modularity(edges: DataFrame, labels: DataFrame, textbook: bool = False) -> DataFrame:
    """(q): modularity of (node, label). Pairs of a node with itself are left out
    unless ``textbook`` is set. Per community it needs only the edges inside,
    the sum of degrees and the sum of their squares."""
    degree = adjacency(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    sums = labels.join(degree, "node").groupBy("label").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("label")), labels.select(F.col("node").alias("dst"), F.col("label").alias("other"))
    inside = edges.join(a, "src").join(b, "dst").where("label = other").groupBy("label").agg(F.count("*").alias("e"))
    m2 = edges.agg((2 * F.count("*")).alias("m2"))
    own = F.lit(0) if textbook else F.col("q")
    part = 2 * F.coalesce("e", F.lit(0)) - (F.col("s") * F.col("s") - own) / F.col("m2")
    return sums.join(inside, "label", "left").crossJoin(m2).agg((F.sum(part / F.col("m2"))).alias("q"))


def _cut_order(component, edges: list[tuple], degrees: dict, m2: int) -> list[tuple]:
    """(component, step, src, dst, value, q) of one component: the edge of the
    largest betweenness is cut until none is left; q is the component's share of
    the modularity after the cut."""
    near = {k: set(v) for k, v in _neighbours(edges).items()}
    original = {frozenset(e) for e in edges}

    def groups(nodes) -> list[set]:
        left, out = set(nodes), []
        while left:
            queue, group = [left.pop()], set()
            while queue:
                u = queue.pop()
                group.add(u)
                fresh = near[u] & left
                left -= fresh
                queue += fresh
            out.append(group)
        return out

    def share(group: set) -> float:
        if len(group) < 2:
            return 0.0
        e = sum(1 for x in original if x <= group)
        s, q = sum(degrees[v] for v in group), sum(degrees[v] ** 2 for v in group)
        return (2 * e - (s * s - q) / m2) / m2

    def weights(group: set) -> dict:
        total: dict = defaultdict(float)
        for root in sorted(group):
            for edge, x in _flow(near, root).items():
                total[edge] += x / 2
        return total

    parts = [(g, weights(g), share(g)) for g in groups(near)]
    rows = [(component, 0, None, None, float("inf"), sum(p[2] for p in parts))]
    while any(p[1] for p in parts):
        top = max(max(p[1].values()) for p in parts if p[1])
        u, v = min(e for p in parts for e, x in p[1].items() if x > top - TIE)
        near[u].discard(v)
        near[v].discard(u)
        at = next(i for i, p in enumerate(parts) if u in p[0])
        old = parts.pop(at)[0]
        parts[at:at] = [(g, weights(g), share(g)) for g in groups(old)]
        rows.append((component, len(rows), u, v, float(top), sum(p[2] for p in parts)))
    return rows


def girvan_newman(edges: DataFrame) -> DataFrame:
    """(node, community) of the partition of largest modularity met while the
    edge of the largest betweenness is cut again and again; of equal ones the
    first. Among edges within TIE of the largest the smallest pair is cut.

    Cutting an edge changes nothing outside its component, so components are
    searched apart, each in one task, and their orders of cutting are merged:
    a cut follows the cuts of its own component, else larger values come first.
    """
    edges = materialize(edges.select("src", "dst"))
    found = components(edges)
    m2 = 2 * edges.count()
    degree = adjacency(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    rows = edges.join(found.withColumnRenamed("node", "src"), "src")
    rows = rows.join(degree.select(F.col("node").alias("src"), F.col("k").alias("ks")), "src")
    rows = rows.join(degree.select(F.col("node").alias("dst"), F.col("k").alias("kd")), "dst")
    kind = edges.schema["src"].dataType.simpleString()

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        degrees = dict(zip(pdf["src"], pdf["ks"], strict=True)) | dict(zip(pdf["dst"], pdf["kd"], strict=True))
        listed = list(zip(pdf["src"], pdf["dst"], strict=True))
        out = _cut_order(pdf["component"].iloc[0], listed, degrees, m2)
        frame = pd.DataFrame(out, columns=["component", "step", "src", "dst", "value", "q"])
        return frame.astype({"src": "Int64", "dst": "Int64"}) if kind in ("bigint", "int") else frame

    cuts = rows.groupBy("component").applyInPandas(search, f"component {kind}, step int, src {kind}, dst {kind}, value double, q double")
    own = Window.partitionBy("component").orderBy("step")
    cuts = cuts.withColumns({"bar": F.min("value").over(own), "gain": F.col("q") - F.coalesce(F.lag("q").over(own), F.lit(0.0))})
    cuts = materialize(cuts)
    merged = Window.partitionBy(F.lit(0)).orderBy(F.desc("bar"), "component", "step")
    ranked = cuts.withColumns({"place": F.row_number().over(merged), "total": F.round(F.sum("gain").over(merged), 12)})
    best = ranked.where("place >= " + str(cuts.where("step = 0").count())).groupBy().agg(F.max(F.struct("total", (-F.col("place")).alias("p"))).alias("m")).first()["m"]
    last = 0 if best is None else -best["p"]
    gone = ranked.where((F.col("place") <= last) & F.col("src").isNotNull()).select("src", "dst")
    kept = materialize(edges.join(gone, ["src", "dst"], "left_anti"))
    joined = connected_components(kept)
    return vertices_of(edges).join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("community"))
