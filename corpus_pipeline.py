"""A training corpus in five stages, each written as Parquet and read again as the next one's documents.

All stages take whole tables. Null and empty texts are documents without words, repeated rows and null ids are rows of
their own, columns beyond those of documents pass through whatever their names, and empty tables give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from colonnade.llm.common import cut, remove, shared_dir
from colonnade.llm.decontaminate import clean_documents
from colonnade.llm.mixing import mixed_documents
from colonnade.llm.quality import good_documents
from colonnade.llm.sharding import shuffle_into_shards
from colonnade.llm.simhash import without_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade is a half or more; fitted on the labels of these documents.

    Null and empty texts are scored like any other, equal texts alike. Without usable labels no document is better than
    another, and all share one fate.
    """
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the first row: five-word shingles, similarity 0.8 or more.

    Null and empty texts are one group; texts of fewer than five words are one shingle.
    """
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item. Documents and items without words stay and match nothing."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them; a null source is a source. Documents without words are never taken."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in shuffled order: a shard from 0 to 39 and a slot in it, which replace columns of these names."""
    return shuffle_into_shards(docs, 40)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier is fitted iteratively and near copies are components of a graph: no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is removed when the next one has written its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/colonnade-pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if last:
            remove(spark, f"{folder}/{last}")
        docs, last = spark.read.parquet(f"{folder}/{name}"), name
    out = cut(STAGES[-1][1](spark, docs, sf_dir))
    remove(spark, folder)
    return out
