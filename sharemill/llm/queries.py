"""The numbered queries (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hpy_lm, manifest, media, merkle, mixing, packing, secrets, sharding, simhash, token_counts, toxicity, vector_graph, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts every text, then again after 16 characters in its middle gave way to its first 24."""
    trees = token_counts.build(documents(spark, sf_dir))
    edits = {"edit_at": F.floor(F.length("text") / 2).cast("int"), "edit_drop": F.lit(16), "edit_insert": F.substring("text", 1, 24)}
    return token_counts.apply_edits(trees.withColumns(edits))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpy_lm.score(documents(spark, sf_dir))


def op4_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_rake_and_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.documents_mixed(documents(spark, sf_dir))


def op6_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir), 24)


def op7_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(documents(spark, sf_dir))


def op8_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.documents_scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_fingerprints(documents(spark, sf_dir))


def op10_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.tamper_checked(documents(spark, sf_dir))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_ALL = (
    op1_edit_aware_token_counts, op2_simhash_near_dedup, op3_pitman_yor_scores, op4_bounded_space_packing, op5_rake_and_sample, op6_bounded_ring_sharding,
    op7_interleaved_media, op8_toxicity_gru, op9_merkle_fingerprints, op10_linked_secrets,
    op11_merkle_manifest, op12_embedding_near_dedup, op13_tsqr_whitening,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op5_rake_and_sample": mixing.oracle(), "op9_merkle_fingerprints": merkle.ORACLE, "op11_merkle_manifest": manifest.ORACLE, "op12_embedding_near_dedup": vector_graph.ORACLE}
