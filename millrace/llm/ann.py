"""Approximate nearest neighbours by a forest of random-projection trees.

The hyperplanes of the trees are fitted on a bounded sample; then every row is
indexed, that is routed to one leaf of each tree. A query walks all trees
through one shared priority queue, nearest side first, until the leaves taken
hold a given share of the sample. Each (tree, branch), BRANCH leaves beside
each other, is a join key: queries go to the branches in which they take a
leaf, with the set of these leaves, and the rows of those leaves alone are
reranked there by their exact inner products. Branches of many rows are cut
into parts of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.tables import load
from millrace.llm.topk import sound

K = 20
QUERY_STEP = 20
TREES = 2
SAMPLE_ROWS = 1 << 14
#: Rows of the sample in a leaf, about: the depth follows from the rows.
LEAF_ROWS = 4
#: Leaves are taken until they hold this part of the sample, repeats between
#: trees included. Vectors without any cluster structure need this much for a
#: recall of 0.9; see the README.
SEARCH_SHARE = 0.8
#: Leaves of a branch: a set of them is the bits of a long.
BRANCH = 32
PART_ROWS = 4096
QUERIES_PER_TASK = 256


@dataclass(frozen=True)
class Forest:
    """Of every tree the inner nodes' directions and offsets, breadth first,
    and the sample's number of rows in each leaf."""

    depth: int
    directions: np.ndarray
    offsets: np.ndarray
    weights: np.ndarray

    def route(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            side = np.einsum("ij,ij->i", vectors, self.directions[tree, node]) > self.offsets[tree, node]
            node = 2 * node + 1 + side
        return node - (2**self.depth - 1)

    def leaves_for(self, query: np.ndarray, share: float, least: float = 0.0) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue, until they hold
        ``share`` of the sample and ``least`` rows of it. A node's place is the
        sum of the distances by which the query lies on the other side of the
        hyperplanes above it; ties go to the nodes that enter first."""
        inner = 2**self.depth - 1
        margin = self.directions @ query - self.offsets
        queue = [(0.0, tree, tree, 0) for tree in range(len(self.directions))]
        heapq.heapify(queue)
        goal = max(share * self.weights[0].sum(), least)
        found, mass, entered = [], 0.0, len(queue)
        while queue and mass < goal:
            far, _, tree, node = heapq.heappop(queue)
            if node >= inner:
                found.append((tree, node - inner))
                mass += self.weights[tree, node - inner]
                continue
            m = margin[tree, node]
            heapq.heappush(queue, (far + max(0.0, -m), entered, tree, 2 * node + 2))
            heapq.heappush(queue, (far + max(0.0, m), entered + 1, tree, 2 * node + 1))
            entered += 2
        return found


def fit_forest(sample: np.ndarray, trees: int, depth: int, seed: int = 5) -> Forest:
    """Directions join the means of two random halves, sharpened by two-means
    steps; offsets are medians. Deterministic for a given sample."""
    rng = np.random.default_rng(seed)
    inner, width = 2**depth - 1, sample.shape[1]
    directions, offsets = np.zeros((trees, inner, width)), np.zeros((trees, inner))
    weights = np.zeros((trees, 2**depth))
    for tree in range(trees):
        members = {0: np.arange(len(sample))}
        for node in range(inner):
            here = members.pop(node)
            rows = sample[here]
            at = rng.normal(size=width)
            if len(rows) > 3:
                a, b = rows[rng.choice(len(rows), 2, replace=False)]
                for _ in range(4):
                    near = rows @ (a - b) > (a @ a - b @ b) / 2
                    if near.all() or not near.any():
                        break
                    a, b = rows[near].mean(0), rows[~near].mean(0)
                at = a - b if np.linalg.norm(a - b) > 1e-9 else at
            at = at / np.linalg.norm(at)
            directions[tree, node] = at
            offsets[tree, node] = np.median(rows @ at) if len(rows) else 0.0
            side = rows @ at > offsets[tree, node]
            members[2 * node + 1], members[2 * node + 2] = here[~side], here[side]
        for leaf in range(2**depth):
            weights[tree, leaf] = len(members[inner + leaf])
    return Forest(depth, directions, offsets, weights)


def _best(
    query_ids: np.ndarray, queries: np.ndarray, wanted: np.ndarray, ids: np.ndarray, rows: np.ndarray, leaves: np.ndarray, k: int
) -> Iterator[pd.DataFrame]:
    """The k best rows for each query among the rows of the leaves it wants
    (bits). Rows are in order of their leaves. The fast products choose, with a
    margin beyond their rounding; the scores are summed row by row, alike for
    equal vectors, so that ties are true ties."""
    step = max(1, (1 << 21) // max(1, len(rows)))
    here, starts = np.unique(leaves, return_index=True)
    ends = np.append(starts[1:], len(rows))
    for at in range(0, len(queries), step):
        part, bits = queries[at : at + step], wanted[at : at + step]
        scores = np.full((len(part), len(rows)), -np.inf)
        for leaf, a, b in zip(here.tolist(), starts.tolist(), ends.tolist(), strict=True):
            asking = np.flatnonzero(bits >> leaf & 1)
            scores[asking, a:b] = part[asking] @ rows[a:b].T
        scores[query_ids[at : at + step, None] == ids[None, :]] = -np.inf
        n = scores.shape[1]
        bar = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(part), -np.inf)
        i, j = np.nonzero((scores >= (bar - 1e-9 * (1 + np.abs(np.nan_to_num(bar, neginf=0.0))))[:, None]) & np.isfinite(scores))
        score = (part[i] * rows[j]).sum(1)
        found = pd.DataFrame({"query_id": query_ids[at : at + step][i], "vec_id": ids[j], "score": score})
        found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        yield found.groupby("query_id", sort=False).head(k)


def depth_for(rows: int) -> int:
    """Levels that leave about LEAF_ROWS of so many rows in a leaf."""
    return max(0, (rows // LEAF_ROWS).bit_length() - 1)


def search(vectors: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, share: float = SEARCH_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k rows of large inner product.

    Both inputs have ``id`` (long) and ``v`` (array of double). Vectors of each
    length have a forest of their own. Rows with a null id take no part. A
    query's own id is never found. An id given several times counts once in a
    result, with its best vector; a query id given several times is searched
    once, with its smallest vector. A query always meets k rows if there are.
    """
    vectors = vectors.where("id is not null")
    queries = queries.where("id is not null")
    queries = queries.repartition(-(-queries.count() // QUERIES_PER_TASK) or 1, "id").groupBy("id").agg(F.min("v").alias("v"))
    widths = [r["w"] for r in vectors.groupBy(F.size("v").alias("w")).count().orderBy("w").collect()]
    found = [_search(vectors.where(F.size("v") == w), queries.where(F.size("v") == w), w, k, trees, share) for w in widths if w > 0]
    near = reduce(DataFrame.unionByName, found or [_search(vectors, queries, 1, k, trees, share)])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(vectors: DataFrame, queries: DataFrame, width: int, k: int, trees: int, share: float) -> DataFrame:
    """(query_id, vec_id, score) of vectors of one length, k for each part."""
    sample = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE_ROWS).collect()
    points = np.array([r["v"] for r in sample], np.float64).reshape(-1, width)
    forest = fit_forest(points, trees, depth_for(len(points)))
    least = trees * (k + 1)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.stack(frame["v"].to_list())
                for tree in range(trees):
                    leaf = forest.route(x, tree)
                    yield frame.assign(tree=np.int32(tree), branch=(leaf // BRANCH).astype(np.int32), leaf=leaf % BRANCH)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at, rows = [], []
            for i, v in enumerate(frame["v"]):
                wanted: dict[tuple[int, int], int] = {}
                for tree, leaf in forest.leaves_for(v, share, least):
                    key = tree, leaf // BRANCH
                    wanted[key] = wanted.get(key, 0) | 1 << leaf % BRANCH
                at += [i] * len(wanted)
                rows += [(*key, bits) for key, bits in wanted.items()]
            tree, branch, leaf = zip(*rows, strict=True) if rows else ((), (), ())
            yield frame.iloc[at].assign(tree=np.array(tree, np.int32), branch=np.array(branch, np.int32), leaf=np.array(leaf, np.int64))

    schema = "id long, v array<double>, tree int, branch int, leaf long"
    indexed = vectors.select("id", "v").mapInPandas(index, schema)
    routed = queries.select("id", "v").mapInPandas(walk, schema)
    # one row for each branch of the forest, whatever the input
    parts = F.broadcast(indexed.groupBy("tree", "branch").agg(F.ceil(F.count("*") / F.lit(PART_ROWS)).cast("int").alias("parts")))
    rows = indexed.join(parts, ["tree", "branch"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    asked = routed.join(parts, ["tree", "branch"]).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))

    def rerank(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(r):
            r = r.sort_values(["leaf", "id"])
            found = list(
                _best(
                    q["id"].to_numpy(), np.stack(q["v"].to_list()), q["leaf"].to_numpy(),
                    r["id"].to_numpy(), np.stack(r["v"].to_list()), r["leaf"].to_numpy(), k,
                )
            )
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        return pd.concat(found) if found else empty

    key = ["tree", "branch", "part"]
    near = asked.select(*key, "id", "v", "leaf").groupBy(*key).cogroup(rows.select(*key, "id", "v", "leaf").groupBy(*key)).applyInPandas(
        rerank, "query_id long, vec_id long, score double"
    )
    return near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest rows found for every twentieth embedding."""
    table = load(spark, sf_dir, "embeddings").where(sound(F.col("embedding")))
    vectors = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    vectors = vectors.where(F.exists("v", lambda x: x != 0))
    return search(vectors, vectors.where(F.col("id") % QUERY_STEP == 0))
