"""A corpus pipeline over documents: each stage is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hotspan.llm.mixing import mixed
from hotspan.llm.ngram_join import one_of_each
from hotspan.llm.packing import pack
from hotspan.llm.quality import quality_columns
from hotspan.llm.secrets import redact_secrets
from hotspan.llm.tables import read
from hotspan.session import stage_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_columns(docs).where("kept").select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id."""
    return one_of_each(docs).select(docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret."""
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: clean ones once or more, others less."""
    return mixed(docs, read(spark, sf_dir, "labels"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the bins."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", best_fit_packing),
]

#: Similarity components, automata, fitted rates and packing are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage_table(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
