"""Whole streams: vectors, and the window plan against the fold."""

import random

import pytest

from logdistill.operators.kernel import Options, collapse_blocks, signature, within_budget
from logdistill.plans import distill as P
from logdistill.sources import config, lines

UUID = "123e4567-e89b-12d3-a456-4266141740"


def reduced(spark, text, **o):
    df = P.reduce_lines(lines.from_strings(spark, {"s": text}), Options(**o))
    return [r.text for r in df.orderBy("out_no").collect()]


def test_repeats_fold(spark):
    text = f"[INFO] boot ok\n[ERROR] request {UUID}00 failed\n[ERROR] request {UUID}11 failed\n"
    assert reduced(spark, text) == ["[x2] [ERROR] request [ID] failed"]
    amounts = ["99.99", "49.50", "12.00", "12.00", "7.25"]
    text = "\n".join(f"[ERROR] charge failed requestId={UUID}0{i} amount={a}" for i, a in enumerate(amounts))
    assert reduced(spark, text) == ["[x5] [ERROR] charge failed requestId=[ID] amount=[99.99 | 49.50 | 12.00 | …]"]


def test_context(spark):
    assert reduced(spark, "[ERROR] crash\na\nb\nc") == ["[ERROR] crash", "a", "b"]
    assert reduced(spark, "[ERROR] alpha\n[ERROR] beta\nsoft 0\nsoft 1") == ["[ERROR] alpha", "[ERROR] beta", "soft 0"]
    assert reduced(spark, "[ERROR] alpha\n[ERROR] beta\nsoft 0\nsoft 1", adaptive_context=False)[-1] == "soft 1"


def test_sliding_dedupe_and_level(spark):
    text = "[ERROR] alpha failed\n[ERROR] beta failed\n[ERROR] alpha failed"
    assert reduced(spark, text, dedupe_window=3) == ["[x2] [ERROR] alpha failed", "[ERROR] beta failed"]
    assert len(reduced(spark, text)) == 3
    text = "\n".join(f"[INFO] boot {i}" for i in range(8)) + "\n[WARN] cache warmed successfully\n[ERROR] request failed"
    assert reduced(spark, text) == ["[ERROR] request failed"]


def test_pem_and_severity(spark):
    out = reduced(spark, "[ERROR] auth failed\n-----BEGIN RSA PRIVATE KEY-----\nabc")
    assert out[-1] != "abc" and "[PEM block unterminated - input redacted]" in out
    ladder = "\n".join(f"[{x}] thing failed" for x in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"))
    assert len(reduced(spark, ladder, severity="warn")) == 3


def test_small_passes():
    assert collapse_blocks(list("ababa"), 8) == [0, 1, "[block x2]", 4]
    assert collapse_blocks(list("abcabc"), 2) == [0, 1, 2, 3, 4, 5]
    assert within_budget([1, 100, 50], [5, 5, 5], 10) == [1, 2]
    assert within_budget([100, 1], [50, 3], 5) == [1] and within_budget([1.0], [5], -1) == []
    assert signature("a k=v state 6") == "a k=[VALUE] state [VALUE]"


@pytest.mark.parametrize("level", ["high", "low", "aggressive"])
def test_windows_equal_fold(spark, level):
    rng = random.Random(level)
    pool = ["", "[ERROR] x failed n=1", "[ERROR] x failed n=2", "[WARN] slow", "[INFO] ok", "[NOTICE] n", "plain", "other text", "[PIPE] failed to go",
            "    at f (/a/node_modules/x.js:1:2)", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "task 5", "task 6"]
    texts = {f"s{i}": "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for i in range(40)}
    df, o = lines.from_strings(spark, texts), Options(aggressiveness=level, adaptive_context=True)
    a = [(r.stream_id, r.text) for r in P.reduce_by_windows(df, o).orderBy("stream_id", "line_no").collect()]
    b = [(r.stream_id, r.text) for r in P.reduce_lines(df, o).orderBy("stream_id", "out_no").collect()]
    warned = lambda x: "unterminated" in x[1]  # noqa: E731 - the fold puts the warning before its last group, the windows at the end
    assert [x for x in a if not warned(x)] == [x for x in b if not warned(x)] and sorted(filter(warned, a)) == sorted(filter(warned, b)) != []


def test_empty_table(spark):
    df = spark.createDataFrame([], "stream_id string, line_no long, value string")
    assert P.reduce_lines(df).count() == 0 and P.report(df).count() == 0


def test_config():
    text = "sources:\n  - name: a\n    markers: [x, 'y']\nignores:\n  - ^skip\n  - 5\nsanitizers:\n  - pattern: foo\n    replacement: bar # note\n"
    c = config.parse(text)
    assert c["sources"] == {"a": ["x", "y"]} and c["ignores"] == ["^skip"] and c["sanitizers"] == [("foo", "bar", "gu")]
    with pytest.raises(config.InvalidConfig):
        config.parse("ignores:\n  - '('\n")
    assert config.load("/nowhere")["sources"] == {}


def test_paths(tmp_path):
    assert lines.output_path("a/b.log") == "a/b.distilled.log" and lines.output_path("x") == "x.distilled.log"
    assert lines.same_path("/A/b", "/a/B")
