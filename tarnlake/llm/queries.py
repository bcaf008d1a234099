"""The subpackage's queries with their production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, fingerprints, html_text, langid, mixing, pieces, quotations, sharding, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), mixing.WEIGHTS, mixing.OTHER, mixing.EPOCHS, mixing.SEED)


def op2_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(_table(spark, sf_dir, "conversations"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), 16)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sample_pieces(_table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    labels = langid.learnable(_table(spark, sf_dir, "labels"), mod=3, but=1)
    return toxicity.fit(_table(spark, sf_dir, "documents"), labels)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(langid.learnable(docs)))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_quotations, op3_exact_dedup, op4_sharding, op5_pieces, op6_toxicity, op7_simhash, op8_langid, op9_html_text, op10_fingerprints, pipeline)
}
ORACLES = {"op1_mixing": mixing.ORACLE, "op2_quotations": quotations.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE}
