"""A pipeline over ``documents`` made of the operators for training data.

Every stage works on all rows that its predecessor kept and takes effect on them: rejected
documents go, repeated text is cut, and the last stage packs what is left. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sentspark.llm.jaccard import one_of_each
from sentspark.llm.packing import byte_vocabulary, packed
from sentspark.llm.passages import remove_passages
from sentspark.llm.quality import quality_filter
from sentspark.llm.toxicity import toxicity_filter
from sentspark.session import ship_package
from sentspark.storage import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    ship_package(spark)
    return quality_filter(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic; the labels are read from ``sf_dir``."""
    ship_package(spark)
    return toxicity_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    ship_package(spark)
    return one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the byte strings and word sequences that are repeated among them."""
    ship_package(spark)
    return remove_passages(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences."""
    ship_package(spark)
    return packed(docs, byte_vocabulary())


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("packing", packing),
]

#: SQL cannot express the toxicity stage, which is trained by gradient steps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
