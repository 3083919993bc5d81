"""A training-corpus pipeline of five stages; each works on all documents that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as Parquet in the
shared folder and reads it again as the next stage's input. All stages but the last return the columns of documents; the
last returns the mixture: a row for each document and epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from plumbline.llm.common import Store, scratch, table
from plumbline.llm.queries import DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS, with_domain


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the longest original stays."""
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the smallest id stays."""
    return ngram_join.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by domain, language and source up to their budgets, with epochs."""
    return mixing.mix(with_domain(docs), ["domain", "lang", "source"], [DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS])


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("ngram_jaccard", near_stage), ("decontaminate", decontaminate_stage), ("mixing", mixing_stage)]

#: The first and fourth stage are fitted models, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with scratch():
            docs = store.cut(stage(spark, docs, sf_dir), name)
        if before:
            store.drop(before)
        before = name
    return docs
