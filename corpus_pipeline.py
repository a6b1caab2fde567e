"""A corpus pipeline of four stages. Each takes the documents that its predecessor kept, as Parquet, and passes on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import ngram_join, packing, quality_classifier, quality_rules
from corvane.llm.catalogue import BYTE_BPE
from corvane.llm.common import documents, scratch_path

#: Words in a shingle and least Jaccard similarity, in percent, of near duplicates; op1's contract sets other values for op1 alone.
WIDTH, PERCENT = 5, 80


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are multivariate outliers go."""
    return quality_rules.keep_quality(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays."""
    return ngram_join.keep_one_of_each(docs, WIDTH, PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row a piece of a document with its place. The workers also serve the stages of a next run, so they keep nothing."""
    return packing.pack_documents(docs, BYTE_BPE, remember=False)


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("ngram_join", deduplicate), ("packing", pack)]

#: The classifier, the robust estimates and the packing are iterative; a test recomputes every stage plainly, but for the classifier's verdicts, which are op4's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
