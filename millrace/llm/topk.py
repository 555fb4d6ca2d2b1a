"""Exact top-k search by aggregation without random access.

Candidates are dealt into tiles. In each tile every dimension has its sorted
list of (component, row). For a query the lists are read sequentially from the
end that contributes most, a block of each list at a time. Every row seen so
far has a lower bound (its sum, with the least contribution for what is
unseen) and an upper bound (with the last contribution read for what is
unseen). Rows whose upper bound is below the k-th best lower bound are given
up; reading stops when no outsider can qualify and few rows are left, whose
final scores are then resolved. The tiles' k best are merged by score. One tile
is searched first: its k-th best score is a bound below which no row of any
other tile can qualify, so the other tiles start with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.tables import load
from millrace.scratch import materialize

K = 10
SCALE = 1024
LONG_MOST = (1 << 63) - 1
QUERY_STEP = 100
TILE_ROWS = 4096
MIN_TILES = 24
QUERY_BLOCK = 4096
DEPTHS = (0.125, 0.25, 0.5, 0.75, 1.0)


def sound(vector: Column) -> Column:
    """The vector is not null and holds finite components only."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def blocks(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``block`` and ``tile``: every query meets every row in
    just one (block, tile). Sizes come from counts, so a task's share is
    bounded; rows are copied once per block of QUERY_BLOCK queries."""
    tiles = max(MIN_TILES, -(-n_rows // tile_rows))
    parts = max(1, -(-n_queries // QUERY_BLOCK))
    left = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn(
        "tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    )
    right = rows.withColumn("tile", F.pmod(F.xxhash64("id", "v"), F.lit(tiles)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    return left, right


def search_tile(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, bars: np.ndarray | None = None
) -> list[tuple[int, int, int]]:
    """(query id, id, score) of the k best rows of the tile for each query;
    ties to the smaller id. Vectors are integers, held as doubles. ``bars``:
    for each query a score below which rows may be left out."""
    n, width = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable").T.copy()
    lists = np.take_along_axis(vectors.T, order, axis=1)
    found = []
    # beyond 2**52 the bounds would be rounded: then every row is resolved, and
    # beyond 2**62 in integers of any size
    largest = width * np.abs(vectors).max(initial=0) * np.abs(queries).max(initial=0)
    plain, whole = largest >= 2.0**52, _integers if largest >= 2.0**62 else np.int64
    exact = vectors.astype(np.int64) if whole is np.int64 else _integers(vectors)
    bars = np.full(len(queries), -np.inf) if bars is None else bars
    depths = sorted({min(n, max(1, int(np.ceil(n * d)))) for d in DEPTHS})
    for query_id, q, outer in zip(query_ids.tolist(), queries, bars, strict=True):
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        least = np.concatenate((lists[up, 0] * q[up], lists[down, -1] * q[down]))
        low, done = np.full(n, least.sum()), 0
        alive = np.flatnonzero(ids != query_id)
        want = min(k, len(alive))
        if not want:
            continue
        seen_rows = []
        for depth in [] if plain else depths:
            rows = np.concatenate((order[up, n - depth : n - done], order[down, done:depth]))
            gain = np.concatenate((lists[up, n - depth : n - done] * q[up, None], lists[down, done:depth] * q[down, None]))
            low += np.bincount(rows.ravel(), (gain - least[:, None]).ravel(), minlength=n)
            seen_rows.append(rows)
            done = depth
            if depth == n:
                break
            # last contribution read of each list, above its least one: what an unseen component can add
            edge = np.concatenate((lists[up, n - depth] * q[up], lists[down, depth - 1] * q[down])) - least
            high = low + edge.sum()
            for part in seen_rows:
                high -= np.bincount(part.ravel(), np.repeat(edge, part.shape[1]), minlength=n)
            bar = max(outer, np.partition(low[alive], len(alive) - want)[len(alive) - want]) if len(alive) >= want else outer
            alive = alive[high[alive] >= bar]
            if len(alive) <= max(4 * k, n // 8):
                break
        score = exact[alive] @ (q.astype(np.int64) if whole is np.int64 else _integers(q))
        best = np.lexsort((ids[alive], -score))[:k] if whole is np.int64 else sorted(range(len(alive)), key=lambda i: (-score[i], ids[alive[i]]))[:k]
        found += [(query_id, int(i), int(s)) for i, s in zip(ids[alive][best], score[best], strict=True)]
    return found


def _integers(x: np.ndarray) -> np.ndarray:
    """Whole numbers held as doubles, as integers of any size."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def top_k(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner product
    for each query, its own id excluded.

    Both inputs have ``id`` (long) and ``v`` (array of whole numbers, as
    doubles); a query id given several times counts once, with its smallest
    vector. A row id given several times takes a place for each of its rows;
    rows alike in id and vector are searched once and then repeated. Only
    vectors of equal length meet. Rows with a null id take no part. A score
    beyond a long is given as the nearest long, and such scores are ranked by
    their nearest doubles.
    """
    queries = queries.where("id is not null").groupBy(F.col("id").alias("id")).agg(F.min("v").alias("v"))
    rows = rows.where("id is not null").groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    left, right = blocks(queries, rows, queries.count(), rows.count())

    def search(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            widths = r["v"].map(len)
            for width, some in q.groupby(q["v"].map(len)):
                same = r[widths == width]
                if width and len(same):
                    times = dict(zip(same["id"], same["times"], strict=True)) if (same["times"] > 1).any() else {}
                    found = search_tile(
                        same["id"].to_numpy(), np.stack(same["v"].to_list()), some["id"].to_numpy(), np.stack(some["v"].to_list()), k,
                        some["bar"].fillna(-np.inf).to_numpy(np.float64),
                    )
                    out += [(a, b, max(-LONG_MOST - 1, min(LONG_MOST, s)), float(s), times.get(b, 1)) for a, b, s in found]
        kinds = {"query_id": "int64", "vec_id": "int64", "score": "int64", "size": "float64", "times": "int32"}
        return pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    def searched(asked: DataFrame, tiles: DataFrame) -> DataFrame:
        schema = "query_id long, vec_id long, score long, size double, times int"
        near = asked.groupBy("block", "tile").cogroup(tiles.groupBy("block", "tile")).applyInPandas(search, schema)
        return near.select("*", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))

    best = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("score"), "vec_id")
    first = searched(left.where("tile = 0").withColumn("bar", F.lit(None).cast("double")), right.where("tile = 0"))
    bars = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("size").alias("bar"))
    # the bar is the nearest double, so one unit below it is safe
    bars = bars.withColumn("bar", F.col("bar") - F.greatest(F.lit(1.0), F.abs("bar") * F.lit(2.0**-52)))
    near = searched(left.join(materialize(bars), "id", "left"), right)
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantized(vectors: DataFrame) -> DataFrame:
    """``id`` and ``v``: floor(1024 x) of every component, for sound vectors,
    as doubles. From 2**52 on a double is a whole number as it stands."""
    whole = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x: F.when(F.abs(x * SCALE) < 2.0**52, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE),
    )
    return vectors.where(sound(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), whole.alias("v"))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of every hundredth embedding."""
    rows = quantized(load(spark, sf_dir, "embeddings"))
    return top_k(rows.where(F.col("id") % QUERY_STEP == 0), rows)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
