"""The command line, renderings of reports, and paths."""

import io
import json

from pyspark.sql import functions as F

from logdistill.__main__ import main
from logdistill.plans import distill
from logdistill.sources import lines, rendering

LOG = "[INFO] up\n[ERROR] disk full on node a\n[ERROR] disk full on node a\nnext\n"


def test_streams(spark):
    out, err = io.StringIO(), io.StringIO()
    assert main(["--json", "--stats"], spark, io.StringIO(LOG), out, err) == 0
    *kept, told = out.getvalue().splitlines()
    assert kept == ["[x2] [ERROR] disk full on node a", "next"] and json.loads(told)["input_lines"] == 4
    assert "  input lines     : 4\n" in err.getvalue() and err.getvalue().endswith("%\n")


def test_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    name, to = str(tmp_path / "a.log"), str(tmp_path / "b.log")
    err = io.StringIO()
    assert main([name, "-o", name], spark, stderr=err) == 2 and "different" in err.getvalue()
    assert main([name, "-o", to], spark) == 0
    assert (tmp_path / "b.log").read_text() == "[x2] [ERROR] disk full on node a\nnext\n"
    assert (tmp_path / "a.log").read_text() == LOG


def test_renderings(spark):
    r = distill.report(lines.from_strings(spark, {"s": LOG, "none": ""}))
    rows = {x.stream_id: x for x in r.select("stream_id", "savings_percent", rendering.as_text().alias("t"), rendering.as_json(r).alias("j")).collect()}
    assert f"  savings         : {rows['s'].savings_percent:.2f}%\n" in rows["s"].t and json.loads(rows["s"].j)["stream_id"] == "s"


def test_paths(spark):
    df = spark.createDataFrame([("a.log",), ("a.trace",), ("a.gz",), ("a.LOG",), ("a.distilled.log",)], "p string")
    got = df.select(lines.is_log_path(F.col("p")), lines.is_reduced_path(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, False), (False, False), (False, False), (True, True)]
