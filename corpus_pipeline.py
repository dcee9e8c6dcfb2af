"""The training-data pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
documents. run() applies them one after another and keeps each result as a table in shared storage, so that a
lost executor costs the current stage's tasks and no more.

Edge cases: a null or empty text fails the base rule and goes; a stage that gets one all the same keeps it (near-duplicates: each null text is a class
of its own; decontamination: no words, no hits; mixing: size 0, as often as its source's blocks; sharding: size 1). Null ids and sources are ordinary values.
Repeated rows are one document to the near-duplicate stage and rows of their own to the others. No rows in, no rows out. Columns beside those of documents are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harken.llm import decontam, mixing, neardup, quality, sharding
from harken.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the least id."""
    return neardup.deduplicated(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    judged = decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document of the mix."""
    return sharding.shard(docs).select("doc_id", "size", "text_crc32", "row_number", "shard", "slot")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", shards),
]

#: The near-duplicate stage samples by hash, which SQL cannot express; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
