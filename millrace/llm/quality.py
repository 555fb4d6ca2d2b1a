"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic classifier, trained on a bounded sample of labelled rows, gives each
document's evidence from measures of its whole text. Grouped aggregation gives
the mean evidence of every host and path. Each path's mean is shrunk toward
its host's and each host's toward the global one, the more the fewer documents
it has; the strengths come from the spread between groups (method of moments).
A document's quality joins its own evidence with the shrunk prior of its path.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.tables import load
from millrace.scratch import materialize

SAMPLE_ROWS = 4000
RIDGE = 1.0
KEEP_AT = 0.5
LEAST, MOST = 1.0, 1e6
CLIP = 1e-6


def measures(text: Column) -> dict[str, Column]:
    """Measures of a whole text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.split(text, " ", -1)
    size = F.greatest(F.length(text), F.lit(1))
    count = F.size(words)
    return {
        "length": F.log1p(F.length(text).cast("double")),
        "symbols": F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,]")) / size,
        "digits": F.regexp_count(text, F.lit(r"[0-9]")) / size,
        "stops": F.regexp_count(text, F.lit(r"[.,]")) / size,
        "blanks": count / size,
        "variety": F.size(F.array_distinct(words)) / F.sqrt(count.cast("double")),
        "repeats": 1 - F.size(F.array_distinct(words)) / count,
        "lines": F.size(F.split(text, "\n", -1)) / F.sqrt(size.cast("double")),
    }


@dataclass(frozen=True)
class QualityModel:
    """Standardised logistic regression over ``measures``."""

    names: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logit(self, text: Column) -> Column:
        """The evidence of a text, with measures held to four deviations."""
        total = F.lit(float(self.bias))
        columns = measures(text)
        for name, mean, scale, weight in zip(self.names, self.mean, self.scale, self.weights, strict=True):
            z = (columns[name] - float(mean)) / float(scale)
            total = total + F.greatest(F.lit(-4.0), F.least(F.lit(4.0), z)) * float(weight)
        return total


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...]) -> QualityModel:
    """Ridge logistic regression by Newton steps. With no rows or one class the
    weights are 0 and the bias is the smoothed log odds."""
    mean = x.mean(0) if len(x) else np.zeros(len(names))
    scale = np.maximum(x.std(0), 1e-9) if len(x) else np.ones(len(names))
    smooth = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(np.unique(y)) < 2:
        return QualityModel(names, mean, scale, np.zeros(len(names)), smooth)
    z = np.hstack([np.ones((len(x), 1)), np.clip((x - mean) / scale, -4, 4)])
    penalty = np.diag([0.0] + [RIDGE] * len(names))
    w = np.zeros(z.shape[1])
    w[0] = smooth
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return QualityModel(names, mean, scale, w[1:], float(w[0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on at most SAMPLE_ROWS labelled rows, in hash order of the id. Labels
    that are null, or contradict each other for an id, are left out."""
    clear = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.min("quality").alias("y"), F.max("quality").alias("z")
    )
    # the limit bounds what is broadcast
    chosen = clear.where("y = z").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("id", "y")
    parts = measures(F.col(text_col))
    rows = (
        docs.join(F.broadcast(chosen), F.col(id_col) == F.col("id"))
        .select("id", "y", *[c.cast("double").alias(n) for n, c in parts.items()])
        .orderBy(F.xxhash64("id"), "id", *parts)
        .limit(SAMPLE_ROWS)
        .collect()
    )
    x = np.array([[r[n] for n in parts] for r in rows], float).reshape(len(rows), len(parts))
    return fit(x, np.array([1.0 if r["y"] else 0.0 for r in rows]), tuple(parts))


def strength(groups: DataFrame, prior: str) -> float:
    """Weight of the prior in documents: its variance as a proportion over the
    variance between groups that sampling does not explain, less one.

    ``groups`` has n, s (sum), q (sum of squares) and the column ``prior``.
    """
    mean, within = F.col("s") / F.col("n"), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)
    row = (
        groups.where("n > 1")
        .agg(
            F.sum(F.col("n") * F.pow(mean - F.col(prior), 2)).alias("between"),
            F.sum(F.greatest(within, F.lit(0.0))).alias("noise"),
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))).alias("unit"),
        )
        .first()
    )
    if not row["n"]:
        return LEAST
    spread = (row["between"] - row["noise"]) / row["n"]
    return MOST if spread <= 0 else float(min(MOST, max(LEAST, row["unit"] / row["n"] / spread - 1)))


def logit(p: Column) -> Column:
    held = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    return F.log(held / (1 - held))


def shrink(scored: DataFrame) -> DataFrame:
    """``scored`` (id, host, path, p) with ``host_score``, ``path_score`` and
    ``quality``. Null hosts and paths are groups of their own. In ``quality`` a
    document meets the scores of its site as the other documents give them, so
    that its own evidence counts once."""
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")]
    paths = materialize(scored.groupBy("host", "path").agg(*sums))
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")])
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    overall = total["s"] / total["n"] if total["n"] else 0.5
    hosts = hosts.withColumn("prior", F.lit(overall))
    k = strength(hosts, "prior")
    host_score = (F.col("s") + k * F.col("prior")) / (F.col("n") + k)
    hosts = hosts.select(F.col("host").alias("_host"), host_score.alias("host_score"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    deep = strength(paths, "host_score")
    paths = paths.select(
        F.col("host").alias("_host"),
        F.col("path").alias("_path"),
        "host_score",
        ((F.col("s") + deep * F.col("host_score")) / (F.col("n") + deep)).alias("path_score"),
        *["host_n", "host_s", "n", "s"],
    )
    joined = scored.join(paths, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    others = (F.col("host_s") - F.col("p") + k * overall) / (F.col("host_n") - 1 + k)
    others = (F.col("s") - F.col("p") + deep * others) / (F.col("n") - 1 + deep)
    evidence = logit(F.col("p")) + logit(others) - logit(F.lit(float(overall)))
    return joined.select(*scored.columns, "host_score", "path_score", (1 / (1 + F.exp(-evidence))).alias("quality"))


def classify(docs: DataFrame, model: QualityModel, host: Column, path: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, host, path, ``doc_score``, ``host_score``,
    ``path_score``, ``quality`` and ``keep`` (quality of KEEP_AT or more).

    Null and empty texts are scored as empty texts. Repeated rows stay and
    count as often as they stand. Ids may be null. Other columns are ignored.
    """
    p = 1 / (1 + F.exp(-model.logit(F.col(text_col))))
    scored = materialize(docs.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), p.alias("p")))
    return shrink(scored).select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("p").alias("doc_score"),
        "host_score",
        "path_score",
        "quality",
        (F.col("quality") >= KEEP_AT).alias("keep"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; its source is the host, source and language
    the path."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = train(docs, load(spark, sf_dir, "labels"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    return classify(docs, model, F.col("source"), path)
