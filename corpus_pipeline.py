"""From raw documents to packed sequences: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bgpforge.llm import common, minhash_dedup, mixing, packing, pii, tokens, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, taught by the labels of these documents, does not reject."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return minhash_dedup.keep_one(docs, width=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, replaced; n_chars follows the text, where docs has it. Null texts stay null."""
    clean = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokens.default_path())


def _afresh(stage):
    """The stage, begun with executors that have given back the memory which the stages before it took."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.collect(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(name, _afresh(stage)) for name, stage in (("toxicity", reject_toxic), ("minhash near-dedup", drop_near_copies), ("pii", redact), ("mixing", mix), ("packing", pack))]

#: SQL expresses neither classifier nor tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            after = common.written(after, "stage")
        common.drop(docs)
        docs = after
    return docs
