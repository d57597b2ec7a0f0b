"""From raw documents to shards: quality, near-duplicates, decontamination, mixing, sharding.

Every stage takes the documents that its predecessor kept, written as Parquet and read again, and all of its decisions take
effect on the rows: rejected documents, all but one of a group of near-duplicates and documents with benchmark passages go;
the mix repeats or leaves out documents; the last stage adds each row's shard and page.

Nulls may be in any column: a null text is an empty one, null ids and sources are values like others. Repeated rows are judged
alike and then thinned out as near-duplicates. Columns that a stage doesn't know pass through it, whatever their names; the last
stage's own columns replace those of the same name. No documents give no documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, quality, sharding, simhash
from tessera.llm.common import documents, stored
from tessera.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.7 or more, learned from the labels of those that are here."""
    return quality.keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash fingerprints within two bits bring candidates by the grid of operator 9,
    min-hashes those that differ in more bits, and a five-word Jaccard similarity of 0.8 or more links them."""
    ship(spark)
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark."""
    return decontaminate.remove(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    ship(spark)
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shards."""
    ship(spark)
    return sharding.shard(docs, keep=tuple(docs.columns))


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("sharding", sharding_stage)]

#: SQL can express neither the classifier nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
