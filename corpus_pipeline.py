"""The corpus pipeline: language ID, quality rules, SimHash near-dedup, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from joinery.llm.crf import recognised
from joinery.llm.packing import packed
from joinery.llm.quality import passing
from joinery.llm.simhash import one_of_each
from joinery.runtime import materialise, table


#: A document whose words are split so evenly among languages has none.
LEAST_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the stage's own input."""
    return recognised(docs, LEAST_LANGUAGE_SCORE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the robust outlier test keep."""
    return passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents packed into sequences: a row for each piece of a document."""
    return packed(docs)


STAGES = [("language ID", language), ("quality rules", quality), ("SimHash near-dedup", near_dedup), ("best-fit packing", packing)]

#: The stages fit models and walk a graph, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
