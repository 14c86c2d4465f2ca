"""Documents to training ids in five stages, each written and read again as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logdistill.llm import mixing, order_minhash, quality, secret_entropy, unigram
from logdistill.llm.common import fresh_path, remove, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Each row has its own verdict, null and repeated ids too; null and blank texts go."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id. Rows with a null id and texts without words stay."""
    return order_minhash.drop_near_duplicates(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets masked; null texts stay null."""
    return secret_entropy.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the target weights; those of a further epoch come again. Null languages and sources are leaves of their own; texts without words go."""
    return mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row, checked by decoding them; a null text has none."""
    return unigram.encode(docs, unigram.Unigram.load())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Stages 2 and 5 aren't SQL; a test compares each stage with a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. A stage's table goes once the next is written, the last when the driver ends.

    Extra columns go along up to the last stage; an empty table gives an empty result.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
