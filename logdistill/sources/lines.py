"""Ordered lines: stream_id, line_no, value."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def explode_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of a text column; a last empty piece after the final line end isn't a line. Null texts have none."""
    pieces = F.split(F.col(text), "\r\n|\n|\r", -1)
    trimmed = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return df.select(F.col(key).cast("string").alias("stream_id"), F.posexplode(trimmed).alias("line_no", "value")).withColumn(
        "line_no", F.col("line_no").cast("long")
    )


def read_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Small and middling files: one stream each, named by path."""
    df = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    return explode_text(df.select(F.col("_metadata.file_path").alias("path"), "value"), "path", "value")


def read_large_file(spark: SparkSession, path: str) -> DataFrame:
    """A file of any size, split over tasks: line_no is the byte offset, which has the order of the lines."""
    rdd = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text"
    )
    df = spark.createDataFrame(rdd, "line_no long, value string")
    return df.select(F.lit(path).alias("stream_id"), "line_no", "value")


def from_strings(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return explode_text(spark.createDataFrame(list(texts.items()), "k string, t string"), "k", "t")


def joined(output: DataFrame) -> DataFrame:
    """stream_id and its output lines as one text."""
    rows = F.array_sort(F.collect_list(F.struct("out_no", "text")))
    return output.groupBy("stream_id").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


def write_lines(output: DataFrame, path: str) -> None:
    """Text files, a folder for each stream, lines in order."""
    ordered = output.repartition("stream_id").sortWithinPartitions("stream_id", "out_no")
    ordered.select("stream_id", "text").write.mode("overwrite").partitionBy("stream_id").text(path)


def same_path(a: str, b: str) -> bool:
    """If two paths name the same file, whatever their case."""
    return os.path.abspath(a).casefold() == os.path.abspath(b).casefold()


def output_path(path: str) -> str:
    root, ext = os.path.splitext(path)
    return f"{root}.distilled{ext or '.log'}"


def is_log_path(path: Column) -> Column:
    """If a path has the extension of a log, in lower case."""
    return path.rlike(r"\.(log|txt|out|err|trace)\z")


def is_reduced_path(path: Column) -> Column:
    """If a path names what a run has written, so that it isn't reduced again."""
    return path.contains(".distilled.") | path.endswith(".distilled")


def event_lines(events: DataFrame) -> DataFrame:
    """A log made of the test table ``events``: one stream for each user."""
    k = F.get_json_object("props", "$.k")
    cents = F.round(F.col("value") * 100).cast("long").cast("string")
    user = F.col("user_id").cast("string")
    value = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("[ERROR] payment failed ip=10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."), k, F.lit(" amount="), cents))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("[WARN] slow purchase took="), k, F.lit("s user="), user))
        .when(F.col("event_type") == "signup", F.concat(F.lit("[INFO] signup ok id="), F.col("event_id").cast("string")))
        .when(F.col("event_type") == "click", F.concat(F.lit("GET /item/"), k, F.lit(" returned 404")))
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" view item="), k))
    )
    return events.select(user.alias("stream_id"), F.col("event_id").alias("line_no"), value.alias("value"))


EVENT_LINES_SQL = """
  select cast(user_id as varchar) as stream_id, event_id as line_no, case event_type
    when 'error' then '[ERROR] payment failed ip=10.0.' || (user_id % 256) || '.' || (props->>'k') || ' amount=' || cast(round(value * 100) as bigint)
    when 'purchase' then '[WARN] slow purchase took=' || (props->>'k') || 's user=' || user_id
    when 'signup' then '[INFO] signup ok id=' || event_id
    when 'click' then 'GET /item/' || (props->>'k') || ' returned 404'
    else strftime(ts, '%Y-%m-%d %H:%M:%S') || ' view item=' || (props->>'k') end as value
  from events"""
