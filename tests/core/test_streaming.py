"""The streaming reduction against the batch fold."""

from logdistill.operators.kernel import Options
from logdistill.plans.distill import reduce_lines
from logdistill.streaming.stream import reduce_stream

SCHEMA = "stream_id string, line_no long, value string"
PARTS = [
    [("a", 0, "[ERROR] charge failed amount=1.50"), ("a", 1, "[ERROR] charge failed amount=2.50"), ("b", 0, "[INFO] boot"), ("b", 1, "soft line")],
    [("a", 2, "[ERROR] charge failed amount=2.50"), ("a", 3, "plain text"), ("b", 2, "[ERROR] disk failed"), ("b", 3, "after one")],
    [("a", 4, None), ("b", 4, "after two"), ("b", 5, None)],
]


def test_stream_equals_batch(spark, tmp_path):
    options = Options(aggressiveness="high")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    query = None
    for rows in PARTS:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        lines = spark.readStream.schema(SCHEMA).parquet(source)
        query = (
            reduce_stream(lines, options)
            .writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "state"))
            .trigger(once=True)
            .start(out)
        )
        assert query.awaitTermination(40)
    got = sorted((r.stream_id, r.out_no, r.text) for r in spark.read.parquet(out).collect())
    whole = spark.createDataFrame([r for p in PARTS for r in p if r[2] is not None], SCHEMA)
    want = sorted((r.stream_id, r.out_no, r.text) for r in reduce_lines(whole, options).collect())
    assert got == want and want
