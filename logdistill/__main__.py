"""Command line: ``python -m logdistill [INPUT] [-o OUTPUT]`` reduces one log; without names, standard input to standard output."""

from __future__ import annotations

import argparse
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from logdistill.operators.kernel import LEVELS, Options
from logdistill.plans import distill
from logdistill.sources import lines as S
from logdistill.sources import rendering
from logdistill.sources.config import load, options

MODES = ("off", "auto", "python", "node", "java", "go", "rust")


def _arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="logdistill")
    p.add_argument("input", nargs="?")
    p.add_argument("-o", "--output")
    p.add_argument("--aggressiveness", choices=(*LEVELS, "auto"), default="auto")
    p.add_argument("--multiline", choices=MODES, default="off")
    p.add_argument("--max-tokens", type=int)
    p.add_argument("--config")
    p.add_argument("--json", action="store_true", help="the report as JSON on standard output")
    p.add_argument("--stats", action="store_true", help="the report as text on standard error")
    return p.parse_args(argv)


def main(argv: list[str], spark: SparkSession | None = None, stdin: TextIO | None = None, stdout: TextIO | None = None, stderr: TextIO | None = None) -> int:
    """0, or 2 if input and output are one file. The output of one log goes through the driver, as a command line's does."""
    stdin, stdout, stderr = stdin or sys.stdin, stdout or sys.stdout, stderr or sys.stderr
    a = _arguments(argv)
    if a.input and a.output and S.same_path(a.input, a.output):
        stderr.write("logdistill: input and output must be different paths\n")
        return 2
    spark = spark or SparkSession.builder.appName("logdistill").getOrCreate()
    lines = S.read_files(spark, a.input) if a.input else S.from_strings(spark, {"stdin": stdin.read()})
    o = options(load(a.config), Options(aggressiveness=a.aggressiveness, multiline=a.multiline, max_tokens=a.max_tokens))
    rows = distill.reduce_lines(lines, o).orderBy("out_no").select("text").toLocalIterator()
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.writelines(f"{r.text}\n" for r in rows)
    else:
        stdout.writelines(f"{r.text}\n" for r in rows)
    if a.json or a.stats:
        told = distill.report(lines, o)
        for r in told.select(rendering.as_json(told).alias("json"), rendering.as_text().alias("text")).collect():
            if a.json:
                stdout.write(f"{r.json}\n")
            if a.stats:
                stderr.write(r.text)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
