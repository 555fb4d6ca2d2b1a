"""Corpus pipeline: documents to token counts in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
what a stage returns as Parquet in the shared folder and reads it back as the
next stage's documents, so a lost executor never costs more than one stage.

Rows with null ids, repeated ids or repeated rows go through all stages; null
texts and texts without a letter are rejected by the first. All columns of
``documents`` come through unchanged, whatever their names, but for ``text``
and ``n_chars``, which follow the removed lines. An empty table gives an empty
result. Of equal rows the near-dedup stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, linededup, mixing, simhash, spm
from millrace.llm.tables import free_names
from millrace.scratch import materialize

#: The mixture of the fourth stage: one pass at most, so no document repeats.
MIXTURE = mixing.QUERY | {"budget_share": 0.8, "max_epochs": 1}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected."""
    return langid.accepted(docs, langid.train(docs))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that occur earlier, and the documents of which nothing is left."""
    lines, removed = free_names(docs, "n_lines", "n_removed")
    clean = linededup.dedup_lines(docs, lines_col=lines, removed_col=removed)
    clean = clean.where((F.col(removed) < F.col(lines)) | (F.col(removed) == 0))
    size = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return clean.withColumns(size).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that share 0.8 of their five-word shingles."""
    return simhash.keep_first(docs, groups=simhash.similar_groups(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the mixture takes."""
    (copies,) = free_names(docs, "copies")
    return mixing.mix(docs, mixing.two_domains(), copies_col=copies, **MIXTURE).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document."""
    return spm.encoding_report(docs, spm.read_model())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece", encode_pieces),
]

#: A trained classifier, XXH64 fingerprints and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return materialize(STAGES[-1][1](spark, docs, sf_dir))
