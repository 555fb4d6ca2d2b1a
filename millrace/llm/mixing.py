"""Mixing of sources to target weights by hierarchical budgeting.

Documents hang on a tree domain - language - source. A token budget flows from
the root to the leaves in proportion to weights. A node never gets more than
its documents can give over ``max_epochs`` passes; what it can't take goes to
its siblings (water-filling), and only what a whole subtree can't take reaches
the siblings of its ancestors. Each leaf then takes whole passes over its
documents and the prefix of one more pass, in an order seeded by pass number.
DataFrame functions only.

Hot leaves: the prefix of a leaf is found through 4096 ranges of its order
keys, so no task sorts a leaf; only the range that holds the cut is sorted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.tables import free_names, load
from millrace.scratch import materialize

LEAF = ["domain", "lang", "source"]
WORD = r"[^\x20\x09-\x0D]+"
RANGE_DIGITS = 3


def _name(column: Column) -> Column:
    """A node's name; null is a node of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def _weight(node: str, weights: Mapping[str, float]) -> Column:
    found = F.lit(1.0)
    for name, value in sorted(weights.items()):
        if not 0 <= value < float("inf"):
            raise ValueError(f"the weight of {name} must be 0 or more and finite")
        found = F.when(F.col(node) == f"={name}", F.lit(float(value))).otherwise(found)
    return found


def _positive(weight: Column) -> Column:
    """The weight for sharing: a node of weight 0 has no cap, so 1 will do."""
    return F.when(weight == 0, F.lit(1.0)).otherwise(weight)


def share_out(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Water-filling among the children of each parent.

    ``nodes`` has ``budget`` (the parent's, on every child), ``weight`` and
    ``cap``. Adds ``share``: the smaller of ``cap`` and weight times the level
    at which the shares of all children sum to the budget.
    """
    before = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("weight"), name)
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parents)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    )
    return (
        nodes.withColumn("level", level)
        .withColumn("share", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(whole)))
        .drop("level")
    )


def budgets(
    leaves: DataFrame,
    budget: float,
    max_epochs: int,
    domain_weights: Mapping[str, float],
    lang_weights: Mapping[str, float],
    source_weights: Mapping[str, float],
) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with ``alloc``, their tokens to
    take. A leaf below a node of weight 0 takes nothing."""
    weights = {n: _weight(n, w) for n, w in zip(LEAF, (domain_weights, lang_weights, source_weights), strict=True)}
    shut = (weights["domain"] == 0) | (weights["lang"] == 0) | (weights["source"] == 0)
    capped = materialize(leaves.withColumn("cap", F.when(shut, F.lit(0)).otherwise(F.col("tokens") * max_epochs)))
    goal = F.lit(float(min(budget, capped.agg(F.sum("cap")).first()[0] or 0)))
    domains = capped.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumns({"root": F.lit(0), "budget": goal})
    domains = share_out(domains.withColumn("weight", _positive(weights["domain"])), ["root"], "domain")
    langs = capped.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    langs = langs.join(domains.select("domain", F.col("share").alias("budget")), "domain")
    langs = share_out(langs.withColumn("weight", _positive(weights["lang"])), ["domain"], "lang")
    ends = capped.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"])
    ends = share_out(ends.withColumn("weight", _positive(weights["source"])), ["domain", "lang"], "source")
    return ends.select(*LEAF, "tokens", F.floor(F.round("share", 6)).cast("long").alias("alloc"))


def order_key(seed: int, epoch: Column, id_col: str) -> Column:
    """Place of a document in the pass ``epoch``: equal for equal ids."""
    text = F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.md5(text.cast("binary"))


def cuts(base: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Per leaf: ``passes`` (whole passes) and ``cut`` (the last order key of
    the partial pass ``passes``; null where it takes nothing)."""
    # written, so that its size is known and the join need not deal out a hot leaf
    leaf = materialize(plan.withColumns(
        {
            "passes": F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(F.lit(0)).cast("long"),
            "rest": F.when(F.col("tokens") > 0, F.col("alloc") % F.col("tokens")).otherwise(F.lit(0)).cast("long"),
        }
    ).select(*LEAF, "passes", "rest"))
    keyed = (
        base.join(leaf, LEAF)
        .withColumn("key", order_key(seed, F.col("passes"), "id"))
        .select(*LEAF, "passes", "rest", "n_tokens", "key", F.substring("key", 1, RANGE_DIGITS).alias("rng"))
    )
    along = Window.partitionBy(*LEAF).orderBy("rng")
    ranges = (
        keyed.groupBy(*LEAF, "rng", "rest")
        .agg(F.sum("n_tokens").alias("t"), F.max("key").alias("last"))
        .withColumn("upto", F.sum("t").over(along))
    )
    whole = ranges.where("upto <= rest").groupBy(*LEAF).agg(F.max("last").alias("cut"))
    split = ranges.where("upto > rest").groupBy(*LEAF).agg(F.min(F.struct("rng", (F.col("upto") - F.col("t")).alias("before"))).alias("m"))
    split = materialize(split.select(*LEAF, "m.rng", "m.before"))
    inside = (
        keyed.join(split, [*LEAF, "rng"])
        .withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEAF, "rng").orderBy("key")))
        .where("upto <= rest")
        .groupBy(*LEAF)
        .agg(F.max("key").alias("cut"))
    )
    found = whole.unionByName(inside).groupBy(*LEAF).agg(F.max("cut").alias("cut"))
    return leaf.select(*LEAF, "passes").join(found, LEAF, "left")


def mix(
    docs: DataFrame,
    domain: Column,
    budget_share: float,
    max_epochs: int = 1,
    domain_weights: Mapping[str, float] | None = None,
    lang_weights: Mapping[str, float] | None = None,
    source_weights: Mapping[str, float] | None = None,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    copies_col: str = "copies",
) -> DataFrame:
    """The documents that the mixture takes, with ``copies`` (or the name given),
    the number of passes that take them.

    The budget is ``budget_share`` times all tokens (words between blanks).
    Weights are by name, 1 where not given, and 0 or more: a node of weight 0
    takes nothing. A null domain, language or source is a node of its own. Rows
    with equal ids share their place in the order and are taken together. Null
    and empty texts have no tokens and follow their place. A column named
    ``copies`` is replaced.
    """
    leaf = {"domain": _name(domain), "lang": _name(F.col("lang")), "source": _name(F.col("source"))}
    count = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    base = materialize(docs.select(F.col(id_col).alias("id"), *[c.alias(n) for n, c in leaf.items()], count.alias("n_tokens")))
    leaves = base.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    goal = float(budget_share) * float(base.agg(F.sum("n_tokens")).first()[0] or 0)
    plan = budgets(leaves, goal, max_epochs, domain_weights or {}, lang_weights or {}, source_weights or {})
    kept = docs.drop(copies_col)
    *names, passes, cut = free_names(kept, *LEAF, "passes", "cut")
    chosen = materialize(cuts(base, plan, seed)).select(
        *[F.col(n).alias(m) for n, m in zip(LEAF, names, strict=True)], F.col("passes").alias(passes), F.col("cut").alias(cut)
    )
    placed = kept.withColumns({m: leaf[n] for n, m in zip(LEAF, names, strict=True)})
    extra = F.coalesce(order_key(seed, F.col(passes), id_col) <= F.col(cut), F.lit(False)).cast("long")
    taken = placed.join(chosen, names).select(*[F.col(c) for c in kept.columns], (F.col(passes) + extra).alias(copies_col))
    return taken.where(F.col(copies_col) > 0)


def two_domains() -> Column:
    """A stand-in for the domain of a document of the test tables, which have no
    such column: ``core`` for source names of up to four letters. Real corpora
    pass a column or a mapping of their own to ``mix``."""
    return F.when(F.length("source") <= 4, F.lit("core")).otherwise(F.lit("extended"))


QUERY = {
    "budget_share": 0.6,
    "max_epochs": 2,
    "domain_weights": {"core": 2.0, "extended": 1.0},
    "lang_weights": {"de": 4.0, "en": 5.0, "es": 3.0, "fr": 2.0},
    "source_weights": {"src0": 3.0, "src12": 2.0},
    "seed": 11,
}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture QUERY with their number of copies."""
    docs = load(spark, sf_dir, "documents")
    return mix(docs, two_domains(), **QUERY).select("doc_id", "lang", "source", "copies")


def mixing_sql(documents: str, budget_share: float, max_epochs: int, domain_weights: Mapping[str, float], lang_weights: Mapping[str, float], source_weights: Mapping[str, float], seed: int) -> str:
    """DuckDB SQL: CTEs that end in ``mixed`` (doc_id, copies) over ``documents``."""

    def weight(column: str, weights: Mapping[str, float]) -> str:
        cases = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in sorted(weights.items()))
        return f"CASE {column} {cases} ELSE CAST(1 AS DOUBLE) END" if cases else "CAST(1 AS DOUBLE)"

    def filled(level: str, inner: str, parents: str, name: str) -> str:
        return f"""{level} AS (
  SELECT *, least(CAST(cap AS DOUBLE), weight * max(lv) OVER (PARTITION BY {parents})) AS share FROM (
    SELECT *, (budget - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER (PARTITION BY {parents}) - coalesce(sum(weight) OVER w, 0)) AS lv
    FROM ({inner})
    WINDOW w AS (PARTITION BY {parents} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""

    return f"""
m_base AS (
  SELECT doc_id, CASE WHEN length(source) <= 4 THEN 'core' ELSE 'extended' END AS domain, lang, source,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS t FROM {documents}),
m_leaf AS (SELECT domain, lang, source, sum(t) AS tokens, sum(t) * {max_epochs} AS cap FROM m_base GROUP BY ALL),
m_goal AS (SELECT least({budget_share} * sum(tokens), sum(cap)) AS goal FROM m_leaf),
{filled("m_d", f"SELECT 0 AS root, domain, sum(cap) AS cap, (SELECT goal FROM m_goal) AS budget, {weight('domain', domain_weights)} AS weight FROM m_leaf GROUP BY domain", "root", "domain")},
{filled("m_l", f"SELECT a.domain, lang, sum(a.cap) AS cap, max(b.share) AS budget, {weight('lang', lang_weights)} AS weight FROM m_leaf a JOIN m_d b USING (domain) GROUP BY a.domain, lang", "domain", "lang")},
{filled("m_s", f"SELECT a.domain, a.lang, source, tokens, a.cap, b.share AS budget, {weight('source', source_weights)} AS weight FROM m_leaf a JOIN m_l b ON a.domain = b.domain AND a.lang = b.lang", "domain, lang", "source")},
m_plan AS (
  SELECT domain, lang, source, CAST(floor(round(share, 6)) AS BIGINT) // greatest(tokens, 1) AS passes,
    CAST(floor(round(share, 6)) AS BIGINT) % greatest(tokens, 1) AS rest FROM m_s),
m_key AS (
  SELECT b.*, passes, rest, md5('{seed}|' || CAST(passes AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)) AS k
  FROM m_base b JOIN m_plan USING (domain, lang, source)),
mixed AS (
  SELECT doc_id, CAST(passes + CASE WHEN sum(t) OVER (PARTITION BY domain, lang, source ORDER BY k) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
  FROM m_key)
"""


OP6_SQL = f"""
WITH {mixing_sql("documents", **QUERY)}
SELECT doc_id, lang, source, copies FROM documents JOIN mixed USING (doc_id) WHERE copies > 0
"""
