"""A training-corpus pipeline over ``documents``: five stages, each one operator of tarnlake.llm.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns the columns of documents; the last
returns the sampled encodings.  Stages are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import exact_dedup, mixing, pieces, simhash
from tarnlake.llm.common import written
from tarnlake.llm.queries import toxicity_model
from tarnlake.llm.toxicity import keep_clean


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go."""
    return keep_clean(docs, toxicity_model(spark, sf_dir))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group one document stays."""
    return simhash.drop_near(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated to their target weights and shuffled."""
    return mixing.mix(docs, mixing.WEIGHTS, mixing.OTHER, mixing.EPOCHS, mixing.SEED).drop("copy", "shuffle_key")


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document."""
    return pieces.sample_pieces(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: Grammar, covering hashing and sampling can't be said in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
