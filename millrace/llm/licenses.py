"""License scan: phrases, and an exact set-similarity join with notices.

Every text is cut into words once. Its blocks are overlapping runs of words,
long enough that whatever SPREAD times a template's length of consecutive words
holds lies in one of them; line ends don't matter, so wrapped notices are found
and long lines don't gather words from afar. A block matches a template when
within such a stretch it holds at least THRESHOLD of the template's distinct
words. Words are ordered by their frequency over all texts, rarest first. A
template of n words of which m are needed shares at least one of its n - m + 1
rarest words with every block to be found (prefix filter), so those words alone
are the join keys; blocks with fewer than m template words are left out (length
filter), and so are pairs whose place in the order leaves too few words to
reach m (positional filter). What is left is compared word by word.
DataFrame functions only.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.tables import load
from millrace.scratch import materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.85
#: Words over which a notice may be spread, as a multiple of its own.
SPREAD = 2
#: The characters beside A-Z whose lower case is or holds one of
#: a-z (the Kelvin sign, the capital I with a dot), and letters in their stead.
ALIEN = {"\u212a": "\u0138", "\u0130": "\u0131"}
#: Phrases, with the label of each.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: License notices, with the label of each.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-2.0-notice": "you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
}


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case; other letters may change to other
    letters, never to A-Z or a-z or from a letter to none."""
    for alien, stand_in in ALIEN.items():
        text = F.replace(text, F.lit(alien), F.lit(stand_in))
    return F.lower(text)


def words_of(text: Column) -> Column:
    """Words of a lower-cased text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _needed(words: list[str]) -> int:
    return ceil(THRESHOLD * len(words) - 1e-9)


#: Words between the starts of two runs; a run is twice as long.
STEP = SPREAD * max(len(t.split()) for t in TEMPLATES.values())


def tokenized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, n_words, parts): the words of every text in parts of STEP words,
    of which those that a template or a phrase has are kept, with their place."""
    vocabulary = sorted({w for t in (*TEMPLATES.values(), *PHRASES) for w in t.split()})
    names = ", ".join(f"'{w}'" for w in vocabulary)
    low = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), words_of(lowered(F.coalesce(text_col, F.lit("")))).alias("ws"))
    part = f"filter(transform(slice(ws, b * {STEP} + 1, {STEP}), (w, k) -> named_struct('at', b * {STEP} + k, 'w', w)), x -> x.w in ({names}))"
    parts = f"if(size(ws) = 0, array(), transform(sequence(0, (size(ws) - 1) div {STEP}), b -> {part.replace('b * ', 'int(b) * ')}))"
    return low.select("id", "h", F.size("ws").cast("long").alias("n_words"), F.expr(parts).alias("parts"))


def _places() -> str:
    """SQL: structs of place ``at`` and ``label`` of every phrase in ``spots``,
    the kept words of a text in order."""
    cases = []
    for phrase, label in PHRASES.items():
        ends = [f"get(spots, k + {n}).w <=> '{w}' and get(spots, k + {n}).at = x.at + {n}" for n, w in enumerate(phrase.split()) if n]
        cases.append(f"when x.w = '{phrase.split()[0]}' and {' and '.join(ends)} then '{label}'")
    every = f"transform(spots, (x, k) -> named_struct('at', x.at, 'label', case {' '.join(cases)} end))"
    return f"filter({every}, p -> p.label is not null)"


def similar_blocks(texts: DataFrame) -> DataFrame:
    """(id, h, label, containment) of every run and template that meet the
    threshold. ``texts`` is as ``tokenized`` gives."""
    spark = texts.sparkSession
    sets = {label: sorted(set(text.split())) for label, text in TEMPLATES.items()}
    words = F.explode(F.expr("flatten(transform(parts, p -> array_distinct(p.w)))")).alias("word")
    counts = {r["word"]: r["n"] for r in texts.select(words).groupBy("word").agg(F.count("*").alias("n")).collect()}
    # the words of the fixed templates and phrases, whatever the input
    order = sorted({w for s in sets.values() for w in s}, key=lambda w: (counts.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes, needs = [], []
    for label, words in sets.items():
        ordered, need = sorted(words, key=place.__getitem__), _needed(words)
        needs.append(need)
        span = SPREAD * len(TEMPLATES[label].split())
        prefixes += [(w, label, p, need, span, ordered) for p, w in enumerate(ordered[: len(ordered) - need + 1])]
    index = F.broadcast(
        spark.createDataFrame(prefixes, "word string, label string, p int, need int, span int, template array<string>")
    )
    run = "concat(parts[int(b)], coalesce(get(parts, int(b) + 1), array()))"
    runs = texts.where("n_words > 0").select("id", "h", F.explode(F.expr(f"transform(sequence(0, size(parts) - 1), b -> {run})")).alias("spots"))
    keys = F.lit(sorted({p[0] for p in prefixes}))
    sized = runs.where(F.size("spots") >= min(needs)).withColumn("has", F.array_distinct("spots.w"))
    sized = sized.where((F.size("has") >= min(needs)) & F.arrays_overlap("has", keys))
    ordered = F.filter(F.lit(order), lambda w: F.array_contains("has", w))
    keyed = sized.select("id", "h", "spots", ordered.alias("known")).select("*", F.posexplode("known").alias("q", "word"))
    pairs = keyed.join(index, "word").where(
        (F.size("known") >= F.col("need"))
        & (F.size("template") - F.col("p") >= F.col("need"))
        & (F.size("known") - F.col("q") + F.col("p") >= F.col("need"))
    )
    here = "filter(spots, y -> y.at between x.at and x.at + span - 1).w"
    close = F.expr(f"array_max(transform(spots, x -> size(array_intersect(template, {here}))))")
    return (
        pairs.where(F.size(F.array_intersect("template", "known")) >= F.col("need"))
        .withColumn("shared", close)
        .where(F.col("shared") >= F.col("need"))
        .select("id", "h", "label", (F.col("shared") / F.size("template")).alias("containment"))
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``n_words``; ``n_base``, ``first_word``,
    ``last_word`` and ``base_labels`` of the phrases; ``labels`` of phrases and
    notices; ``score``: 1 with a phrase, else the best containment found, else 0.

    A null text counts as empty: no words, no labels. Rows that agree in id and
    text get the same result; ids may be null or repeated. Other columns are
    ignored. Equal label sets never depend on the order of rows.
    """
    texts = materialize(tokenized(docs, id_col, text_col))
    found = similar_blocks(texts).groupBy("id", "h").agg(
        F.collect_set("label").alias("similar"), F.max("containment").alias("containment")
    )
    own = (
        texts.select("id", "h", "n_words", F.flatten("parts").alias("spots"))
        .select("id", "h", "n_words", F.expr(_places()).alias("places"))
        .select(
            "id",
            "h",
            "n_words",
            F.size("places").cast("long").alias("n_base"),
            F.array_min(F.expr("places.at")).cast("long").alias("first_word"),
            F.array_max(F.expr("places.at")).cast("long").alias("last_word"),
            F.array_sort(F.array_distinct(F.expr("places.label"))).alias("base"),
        )
    )
    similar = F.coalesce("similar", F.array().cast("array<string>"))
    joined = own.join(
        found.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "similar", "containment"),
        F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")),
        "left",
    )
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", similar)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return scan(load(spark, sf_dir, "documents"))


def _sql() -> str:
    cases = " ".join(
        "WHEN " + " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(phrase.split())) + f" THEN '{label}'"
        for phrase, label in PHRASES.items()
    )
    rows = []
    for label, text in TEMPLATES.items():
        words = sorted(set(text.split()))
        rows.append(f"('{label}', {words!r}, {_needed(words)}, {SPREAD * len(text.split())})")
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t(label, words, need, span) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, {lower} AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(low, '{WORD}') AS w FROM d),
i AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w),
p AS (SELECT doc_id, i, CASE {cases} END AS label FROM i),
b AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base
  FROM p WHERE label IS NOT NULL GROUP BY doc_id
),
v AS (SELECT label, need, span, len(words) AS n, unnest(words) AS word FROM t),
o AS (SELECT doc_id, label, need, span, n, i, word FROM i JOIN v ON word = w[i + 1]),
c AS (SELECT doc_id, label FROM o GROUP BY doc_id, label HAVING count(DISTINCT word) >= any_value(need)),
r AS (
  SELECT a.doc_id, a.label, a.need, a.n, a.i, count(DISTINCT b.word) AS shared
  FROM c JOIN o a USING (doc_id, label)
  JOIN o b ON a.doc_id = b.doc_id AND a.label = b.label AND b.i BETWEEN a.i AND a.i + a.span - 1
  GROUP BY ALL
),
s AS (
  SELECT doc_id, list(DISTINCT label) AS alike, max(shared / n) AS containment
  FROM r WHERE shared >= need GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(alike, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(containment, CAST(0 AS DOUBLE)) END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP10_SQL = _sql()
