"""Work that grows with the lines: each is moved and tried as often as it must be."""

import io
from contextlib import redirect_stdout

from logdistill.operators import detection
from logdistill.plans import distill as P
from logdistill.sources import lines


def plan_of(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_markers_are_looked_for_at_once(spark):
    texts = ["Kubernetes pod is down", "no source", "##[error] x", "task :a", "TASK:a", "error[e0] in rustc", "İ NGINX", ""]
    df = lines.from_strings(spark, {"s": "\n".join(texts)})
    want = {(i, s) for i, v in enumerate(texts) for s, ms in detection.CATALOG.items() if any(m in v.lower() for m in ms)}
    assert {(r.line_no, r.source) for r in detection.hits(df).collect()} == want
    # One marker that begins another, and one that is empty.
    assert sorted(r.source for r in detection.hits(df, {"a": ["kube", "kubernetes"], "b": [""]}).where("line_no = 0").collect()) == ["a", "b"]
    assert plan_of(detection.hits(df)).count("lower(") < 10


def test_fold_moves_scored_lines_once(spark):
    plan = plan_of(P.reduce_lines(spark.createDataFrame([], "stream_id string, line_no long, value string")))
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan and "Join" not in plan
