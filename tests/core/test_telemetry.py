import os

from logdistill import queries


def test_rollup_totals_more_than_a_hundred_runs(spark):
    sf_dir = f"{os.environ.get('TESTDATA_DIR', '/root/testdata')}/sf0.01"
    runs = queries.event_lines(spark, sf_dir).select("stream_id").distinct().count()
    assert 100 < runs <= 1000
    assert queries.telemetry_rollup(spark, sf_dir).first().runs == runs
