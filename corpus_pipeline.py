"""A training corpus from `documents` in five stages; each works on all that the one before it kept.

All stages but the last return the columns of documents: the first three drop rows, the mix repeats or drops them, and
sharding adds shard and slot. The stages write nothing but intermediate tables below the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from entitywatch.llm.common import materialize, table
from entitywatch.llm.decontamination import clean_documents
from entitywatch.llm.jaccard_join import one_of_each
from entitywatch.llm.mixing import mixed_documents, quality_weights
from entitywatch.llm.quality_rules import keep_good
from entitywatch.llm.sharding import sharded_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, quality_weights(table(spark, sf_dir, "labels")))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharded_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_copies),
    ("decontamination", decontaminate),
    ("mix_sources", mix_sources),
    ("sharding", shard),
]
#: No SQL: a trained classifier, tokens' hashes and bisection are beyond it; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
