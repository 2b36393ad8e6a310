"""A corpus from raw documents: drop toxic and poor documents, near duplicates and benchmark leaks, then mix the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import common, decontam, mixing, neardup, quality, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under its threshold."""
    return toxicity.clean(docs, toxicity.learn(docs, common.read(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model scores at its threshold or above."""
    return quality.good(docs, quality.learn(docs, common.read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return neardup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontam.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words taken of each."""
    return mixing.apply_mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: The classifiers cannot be expressed in SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is written and read back."""
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.stash(stage(spark, docs, sf_dir))
    return docs
