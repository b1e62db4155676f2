"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. The result of a
stage is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vicinage.llm import decontamination, exact_dedup, near_dedup, packing, quality
from vicinage.llm.queries import tokenizer
from vicinage.llm.tables import materialize, read


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is fitted on the labelled ones among docs."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the row with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component the smallest doc_id stays."""
    return near_dedup.drop_near_duplicates(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their token ids, placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, tokenizer(), capacity=2048, keep_ids=True)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("benchmark decontamination", clean_of_benchmark),
    ("best-fit packing", packed),
]

#: The classifier and the packing can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
