"""k-means, cluster statistics and summarising multi-round clustering.

``points`` is (id, vec). Centroids and statistics are a few rows of numbers for
each cluster; they travel as literals inside expressions, so a pass over the
points is one scan without joins, and only sums come back to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import beyond, constant, scaled_squares, squared_distance
from millrace.operators.similarity import dense_index
from millrace.scratch import checkpointed, materialize

Centroids = list[tuple[int, list[float]]]


def cluster_stats(points: DataFrame, cluster: str) -> DataFrame:
    """(cluster, dim, n, mean, deviation) over all dimensions."""
    long = points.select(cluster, F.posexplode("vec").alias("dim", "x"))
    sums = long.groupBy(cluster, "dim").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    mean = F.col("s") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select(cluster, "dim", "n", mean.alias("mean"), spread.alias("deviation"))


def vector_sums(points: DataFrame, cluster: str) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(cluster, n, sum, sum of squares) of every cluster, ordered."""
    long = points.select(cluster, F.posexplode("vec").alias("dim", "x"))
    sums = long.groupBy(cluster, "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    grouped = sums.groupBy(cluster).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "s", "q"))).alias("v"))
    rows = grouped.orderBy(cluster).collect()
    return [(r[cluster], r["n"], np.array([x["s"] for x in r["v"]]), np.array([x["q"] for x in r["v"]])) for r in rows]


def nearest(vec: Column, centroids: Centroids) -> Column:
    """Struct of the distance ``d`` to the nearest centroid and its ``k``; ties
    to the smaller k."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), constant(c).alias("c")) for k, c in centroids])
    near = F.transform(table, lambda t: F.struct(squared_distance(vec, t["c"]).alias("d"), t["k"].alias("k")))
    best = F.array_min(near)
    return F.struct(F.sqrt(best["d"]).alias("d"), best["k"].alias("k"))


def assign(points: DataFrame, centroids: Centroids) -> DataFrame:
    """``points`` with ``cluster`` and ``distance``."""
    best = nearest(F.col("vec"), centroids)
    return points.withColumn("_n", best).select(*points.columns, F.col("_n.k").alias("cluster"), F.col("_n.d").alias("distance"))


def first_points(points: DataFrame, k: int) -> Centroids:
    """The k points of the lowest ids."""
    return [(i, list(r["vec"])) for i, r in enumerate(points.orderBy("id").limit(k).collect())]


def far_points(points: DataFrame, k: int) -> Centroids:
    """Starts with the lowest id; then, again and again, the point whose
    distances to those chosen sum to most, ties to the lower id."""
    chosen = first_points(points, 1)
    ids = [r["id"] for r in points.orderBy("id").limit(1).collect()]
    while len(chosen) < k:
        total = F.lit(0.0)
        for _, c in chosen:
            total = total + F.sqrt(squared_distance(F.col("vec"), constant(c)))
        rest = points.where(~F.col("id").isin(ids))
        row = rest.select("id", "vec", F.round(total, 9).alias("t")).orderBy(F.desc("t"), "id").first()
        if row is None:
            break
        ids.append(row["id"])
        chosen.append((len(chosen), list(row["vec"])))
    return chosen


def kmeans(points: DataFrame, start: Centroids, rounds: int = 100, tolerance: float = 1e-4) -> Centroids:
    """Lloyd's rounds; a cluster without points keeps its centroid. Ends when
    the centroids' movements sum to less than the tolerance."""
    centroids = start
    for _ in range(rounds):
        means = {k: (s / n).tolist() for k, n, s, _ in vector_sums(assign(points, centroids), "cluster")}
        moved = [(k, means.get(k, c)) for k, c in centroids]
        change = sum(float(np.linalg.norm(np.subtract(a[1], b[1]))) for a, b in zip(moved, centroids, strict=True))
        centroids = moved
        if change < tolerance:
            break
    return centroids


def best_kmeans(points: DataFrame, starts: Iterable[Centroids], rounds: int = 100) -> Centroids:
    """Of several starts the result of the lowest Davies-Bouldin value."""
    scored = []
    for i, start in enumerate(starts):
        centroids = kmeans(points, start, rounds)
        value = davies_bouldin(assign(points, centroids), clusters=len(centroids)).first()["db"]
        scored.append((float("inf") if value is None else value, i, centroids))
    return min(scored)[2]


def davies_bouldin(points: DataFrame, cluster: str = "cluster", clusters: int | None = None) -> DataFrame:
    """(db): mean over clusters of the worst ratio of summed scatters (mean
    distance to the centroid) to the distance of centroids. Fewer than two
    clusters give null; where ``clusters`` says how many there should be and
    one of them has no points, the value is infinite. The centroids are a model
    of bounded size; only their scatters come from the points."""
    centroids = {k: s / n for k, n, s, _ in vector_sums(points, cluster)}
    spark = points.sparkSession
    if clusters is not None and len(centroids) < clusters:
        return spark.createDataFrame([(float("inf"),)], "db double")
    if len(centroids) < 2:
        return spark.createDataFrame([(None,)], "db double")
    table = spark.createDataFrame([(k, c.tolist()) for k, c in centroids.items()], "k long, c array<double>")
    placed = points.join(table, F.col(cluster) == F.col("k"))
    rows = placed.groupBy("k").agg(F.avg(F.sqrt(squared_distance(F.col("vec"), F.col("c")))).alias("s")).collect()
    scatter = {r["k"]: r["s"] for r in rows}
    worst = [
        max((scatter[a] + scatter[b]) / d if (d := float(np.linalg.norm(centroids[a] - centroids[b]))) else float("inf") for b in scatter if b != a)
        for a in sorted(scatter)
    ]
    return spark.createDataFrame([(sum(worst) / len(worst),)], "db double")


@dataclass
class Summary:
    """Number, sum and sum of squares of a cluster's points."""

    n: int
    total: np.ndarray
    squares: np.ndarray
    members: list[int] = field(default_factory=list)

    @property
    def centre(self) -> np.ndarray:
        return self.total / self.n

    @property
    def deviation(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares / self.n - self.centre**2, 0.0))

    def merged(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, self.total + other.total, self.squares + other.squares, self.members + other.members)

    def distance(self, point: np.ndarray) -> float:
        """Mahalanobis distance for a diagonal covariance; flat dimensions are
        left out."""
        spread = self.deviation
        used = spread > 0
        return float(np.sqrt((((point - self.centre)[used] / spread[used]) ** 2).sum()))


def nearest_summary(vec: Column, summaries: dict[int, Summary]) -> Column:
    """Struct of Mahalanobis distance ``d`` and ``k`` of the nearest summary."""
    table = F.array(
        *[F.struct(F.lit(k).alias("k"), constant(s.centre).alias("c"), constant(s.deviation).alias("v")) for k, s in sorted(summaries.items())]
    )
    near = F.transform(table, lambda t: F.struct(scaled_squares(vec, t["c"], t["v"]).alias("d"), t["k"].alias("k")))
    best = F.array_min(near)
    return F.struct(F.sqrt(best["d"]).alias("d"), best["k"].alias("k"))


def assign_summaries(points: DataFrame, summaries: dict[int, Summary]) -> DataFrame:
    """``points`` with the nearest ``cluster`` and its Mahalanobis ``distance``."""
    best = nearest_summary(F.col("vec"), summaries)
    return points.withColumn("_n", best).select(*points.columns, F.col("_n.k").alias("cluster"), F.col("_n.d").alias("distance"))


def numbered(points: DataFrame) -> DataFrame:
    """``points`` with ``row``, their place by id from 0."""
    return points.join(dense_index(points, "id").withColumnRenamed("idx", "row"), "id")


def outliers(points: DataFrame, ratio: float = 0.5, beta: float = 3.0) -> DataFrame:
    """(id, outlier) of the first ``ratio`` of the points: whether a component
    lies more than ``beta`` deviations from the mean of these points."""
    total = points.count()
    sample = materialize(numbered(points).where(F.col("row") < int(total * ratio)).withColumn("all", F.lit(0)))
    sums = vector_sums(sample, "all")
    if not sums:
        return sample.select("id", F.lit(False).alias("outlier"))
    whole = Summary(*sums[0][1:])
    return sample.select("id", beyond(F.col("vec"), constant(whole.centre), constant(whole.deviation), beta).alias("outlier"))


@dataclass
class RoundReport:
    """State after a round, as counts."""

    round_id: int
    nof_cluster_discard: int
    nof_point_discard: int
    nof_cluster_compression: int
    nof_point_compression: int
    nof_point_retained: int


class SummarisingClusterer:
    """Clusters rounds of points with bounded state.

    Points near a cluster are added to its summary and their ids kept as rows
    (the discard sets); points near a small dense group are added to that (the
    compression sets); the others are retained. Summaries are updated after
    each batch. When a round ends and points enough are retained, these are
    grouped by k-means and groups of two or more become compression sets;
    compression sets that lie close are merged. At the end every compression
    set joins its nearest cluster and retained points are labelled -1.
    """

    def __init__(self, k: int, alpha: float = 4.0, beta: float = 3.0, sample_ratio: float = 0.5, batch_share: float = 0.1, rounds: int = 20):
        self.k, self.alpha, self.beta, self.sample_ratio = k, alpha, beta, sample_ratio
        self.batch_share, self.rounds = batch_share, rounds
        self.discard: dict[int, Summary] = {}
        self.compression: dict[int, Summary] = {}
        self.labels: list[DataFrame] = []
        self.retained: DataFrame | None = None
        self.next_group = 0
        self.reports: list[RoundReport] = []

    def add_round(self, points: DataFrame) -> RoundReport:
        """Take in a round of points (id, vec)."""
        rows = materialize(numbered(points.select("id", "vec")))
        total = rows.count()
        if not self.discard and total:
            rows = self._start(rows, total)
            total = rows.count()
        size = max(1, int(total * self.batch_share))
        if total:
            rows = materialize(numbered(rows.select("id", "vec")))
            for at in range(0, total, size):
                self._batch(rows.where((F.col("row") >= at) & (F.col("row") < at + size)).select("id", "vec"))
        if self.reports:
            self._merge()
        self._compress()
        self.reports.append(self._report())
        return self.reports[-1]

    def _start(self, rows: DataFrame, total: int) -> DataFrame:
        sample = rows.where(F.col("row") < max(1, int(total * self.sample_ratio)))
        flags = outliers(rows.select("id", "vec"), self.sample_ratio, self.beta) if int(total * self.sample_ratio) else None
        core = sample.select("id", "vec")
        if flags is not None:
            core = core.join(flags.where("not outlier").select("id"), "id", "left_semi")
        core = materialize(core)
        centroids = kmeans(core, far_points(core, self.k), self.rounds)
        placed = materialize(assign(core, centroids).select("id", "vec", "cluster"))
        self.discard = {int(k): Summary(n, s, q) for k, n, s, q in vector_sums(placed, "cluster")}
        self._keep(placed, "discard")
        return materialize(rows.join(core.select("id"), "id", "left_anti"))

    def _keep(self, placed: DataFrame, kind: str) -> None:
        self.labels.append(placed.select("id", F.lit(kind).alias("kind"), F.col("cluster").cast("int").alias("cluster")))

    def _batch(self, batch: DataFrame) -> None:
        limit = F.sqrt(F.size("vec").cast("double")) * self.alpha
        first = nearest_summary(F.col("vec"), self.discard)
        second = nearest_summary(F.col("vec"), self.compression) if self.compression else F.lit(None).cast("struct<d:double,k:int>")
        kind = F.when(F.col("a.d") < limit, "discard").when(F.col("b.d") < limit, "compression").otherwise("retained")
        placed = batch.withColumns({"a": first, "b": second}).withColumn("kind", kind)
        cluster = F.when(F.col("kind") == "discard", F.col("a.k")).when(F.col("kind") == "compression", F.col("b.k"))
        placed = materialize(placed.select("id", "vec", "kind", cluster.alias("cluster")))
        for name, state in (("discard", self.discard), ("compression", self.compression)):
            mine = placed.where(F.col("kind") == name)
            for k, n, s, q in vector_sums(mine, "cluster"):
                state[k] = state[k].merged(Summary(n, s, q))
            self._keep(mine, name)
        rest = placed.where("kind = 'retained'").select("id", "vec")
        self.retained = rest if self.retained is None else self.retained.unionByName(rest)

    def _compress(self) -> None:
        if self.retained is None:
            return
        self.retained = materialize(self.retained)
        if self.retained.count() <= 3 * self.k:
            return
        placed = materialize(assign(self.retained, kmeans(self.retained, far_points(self.retained, 3 * self.k), self.rounds)))
        groups = {int(k): Summary(n, s, q) for k, n, s, q in vector_sums(placed, "cluster") if n > 1}
        if not groups:
            return
        names = {k: self.next_group + i for i, k in enumerate(sorted(groups))}
        self.next_group += len(names)
        self.compression |= {names[k]: s for k, s in groups.items()}
        renamed = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("cluster"))
        grouped = placed.where(F.col("cluster").isin(list(names)))
        self._keep(grouped.withColumn("cluster", renamed), "compression")
        self.retained = materialize(placed.where(~F.col("cluster").isin(list(names))).select("id", "vec"))

    def _merge(self) -> None:
        """Merges pairs closer than the root of the dimension, nearest first."""
        moved: dict[int, int] = {}
        keys = sorted(self.compression)
        close = []
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                x, y = self.compression[a], self.compression[b]
                d = min(x.distance(y.centre), y.distance(x.centre))
                if d < np.sqrt(len(x.total)):
                    close.append((round(d, 9), a, b))

        def home(k: int) -> int:
            while k in moved:
                k = moved[k]
            return k

        for _, a, b in sorted(close):
            x, y = home(a), home(b)
            if x != y and b not in moved:
                self.compression[x] = self.compression[x].merged(self.compression.pop(y))
                moved[y] = x
        if moved:
            self._rename("compression", {k: home(k) for k in moved}, "compression")

    def _rename(self, kind: str, names: dict[int, int], new_kind: str) -> None:
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        hit = (F.col("kind") == kind) & F.col("cluster").isin(list(names))
        self.labels = [
            t.select(
                "id",
                F.when(hit, F.lit(new_kind)).otherwise(F.col("kind")).alias("kind"),
                F.when(hit, F.element_at(table, F.col("cluster"))).otherwise(F.col("cluster")).alias("cluster"),
            )
            for t in self.labels
        ]

    def _report(self) -> RoundReport:
        left = 0 if self.retained is None else self.retained.count()
        return RoundReport(
            len(self.reports) + 1,
            len(self.discard),
            sum(s.n for s in self.discard.values()),
            len(self.compression),
            sum(s.n for s in self.compression.values()),
            left,
        )

    def finish(self) -> DataFrame:
        """(id, cluster) of all points."""
        names = {}
        for k, s in sorted(self.compression.items()):
            best = min(self.discard, key=lambda d: (round(self.discard[d].distance(s.centre), 9), d))
            names[k] = best
        if names:
            self._rename("compression", names, "discard")
            for k, best in names.items():
                self.discard[best] = self.discard[best].merged(self.compression[k])
            self.compression = {}
        parts = [t.select("id", "cluster") for t in self.labels]
        if self.retained is not None:
            parts.append(self.retained.select("id", F.lit(-1).alias("cluster")))
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return checkpointed(whole)


def cluster_rounds(batches: Iterable[DataFrame], k: int, **options) -> tuple[DataFrame, list[RoundReport]]:
    """Labels of all points and the report of every round."""
    clusterer = SummarisingClusterer(k, **options)
    for points in batches:
        clusterer.add_round(points)
    return clusterer.finish(), clusterer.reports


def in_rounds(points: DataFrame, n: int) -> list[DataFrame]:
    """``points`` cut into n rounds by order of id."""
    total = points.count()
    rows = materialize(numbered(points))
    size = -(-total // n) if total else 1
    return [rows.where(F.floor(F.col("row") / F.lit(size)) == i).select("id", "vec") for i in range(n)]


