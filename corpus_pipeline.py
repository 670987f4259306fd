"""Corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, source mix.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; all but the
last return the columns of ``docs``, whatever further columns there are.

Edge cases: null and empty texts pass every filter unless labelled texts say that empty ones are
toxic; a null doc_id is a value like others; rows that repeat doc_id and text are one near-duplicate
group; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import common, decontamination, jaccard_join, pii_crf, source_mix, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the scorer learns from the labelled rows among ``docs``."""
    scorer = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = common.fresh(docs, "toxic_score")
    return toxicity.toxic_scores(docs, scorer, score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each component of similar documents."""
    return jaccard_join.one_per_component(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii_crf.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return source_mix.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", redact_pii),
    ("source_mix", mix),
]

ORACLE_SQL = None  # trained stages and exact alignments have no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.cut(docs)
    return docs
