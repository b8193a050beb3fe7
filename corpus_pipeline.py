"""The training-data pipeline: toxicity, exact de-duplication, near de-duplication, substring de-duplication, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import exact_dedup, packing, simhash, substrings, toxicity_pu
from tidewright.llm.common import drop_saved, saved, saved_so_far


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold of toxicity; learned from the training fold of labels."""
    return toxicity_pu.clean(docs, toxicity_pu.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, as operator 3 defines them: fingerprints of three-word shingles
    that chains of at most three differing bits connect."""
    return simhash.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words or more that stand more than once."""
    return substrings.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.best_fit_packing(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("SimHash near-dedup", near), ("substring dedup", passages), ("best-fit packing", packed)]

#: Fitted classifiers, fingerprints and token ids are beyond SQL: the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared scratch folder and read again; what a stage has
    written on the way to its result is then deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        mark = saved_so_far()
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        drop_saved(spark, mark, last=False)
    return docs
