"""The queries of this subpackage, with production parameters over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, embedding_dedup, minhash_dedup, mixing, neighbours, packing, pii, quality, tables, token_counts, tokens, toxicity

END_OF_DOCUMENT = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokens.default_path())


def op5_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.scratch(spark, "tables")
    manifest = tables.write_tables(_table(spark, sf_dir, "documents"), tokens.default_path(), END_OF_DOCUMENT, folder)
    return tables.read_tables(spark, manifest, with_ids=False)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("ticket")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokens.default_path())


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_token_counts": op4_token_counts,
    "op5_token_tables": op5_token_tables,
    "op6_pii": op6_pii,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_quality": op10_quality,
}

SQL: dict[str, str] = {}
