"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logdistill.llm import (
    hnsw,
    license_scan,
    maglev,
    mixing,
    order_minhash,
    packing,
    quality,
    secret_entropy,
    token_counts,
    unigram,
)
from logdistill.llm.common import table


def _documents(use: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: use(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": _documents(token_counts.rollup),
        "op2_order_minhash": _documents(order_minhash.near_duplicates),
        "op3_unigram": _documents(lambda d: unigram.encode(d, unigram.Unigram.load())),
        "op4_sharding": _documents(lambda d: maglev.assign_shards(d, "doc_id")),
        "op5_hnsw": lambda spark, sf_dir: hnsw.near_duplicate_vectors(table(spark, sf_dir, "embeddings")),
        "op6_license_scan": _documents(license_scan.scan),
        "op7_packing": _documents(packing.pack),
        "op8_quality": _documents(quality.quality_rules),
        "op9_mixing": _documents(mixing.mix),
        "op10_secret_scan": _documents(secret_entropy.scan),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_sharding": maglev.oracle(), "op8_quality": quality.oracle(), "op10_secret_scan": secret_entropy.oracle()}
