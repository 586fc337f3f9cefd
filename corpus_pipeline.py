"""A corpus from raw documents: quality rules, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; what a
stage returns is written as Parquet and read again as the docs of the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepgrid.llm.common import delete, shared_dir, ship_package, table, word_count
from sweepgrid.llm.decontam import clean_rows
from sweepgrid.llm.fertility import quality_rows
from sweepgrid.llm.mixing import mixed_rows
from sweepgrid.llm.probminhash import distinct_rows
from sweepgrid.llm.shards import feistel_shards

ship_package()


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rows(docs)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return distinct_rows(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return clean_rows(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixed_rows(docs, word_count(F.col("text")))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return feistel_shards(docs, ["doc_id"])


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL cannot state the tokeniser, the sketches and the permutations; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
            if k:  # what the stage before left is read no more
                delete(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
