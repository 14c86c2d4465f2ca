"""A store of run reports: appended, newest first, with totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 1000


def record(report: DataFrame, path: str) -> None:
    """Appends the runs of a report; nothing is rewritten."""
    report.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def newest(runs: DataFrame, n: int = KEPT) -> DataFrame:
    return runs.orderBy(F.desc("at"), "stream_id").limit(n)


def load(spark: SparkSession, path: str) -> DataFrame:
    return newest(spark.read.parquet(path))


def totals(runs: DataFrame) -> DataFrame:
    """runs, tokens in and out, saved, and the average saving weighted by input."""
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
    ).withColumn("saved_permille", F.when(F.col("input_tokens") > 0, F.floor(1000 * F.col("saved_tokens") / F.col("input_tokens"))).otherwise(0))
