"""Rows of ``plans.distill.report`` as text and as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of the text, and the columns that they show.
SHOWN = {
    "input lines": "input_lines",
    "output lines": "output_lines",
    "dropped lines": "dropped_lines",
    "duplicate lines": "duplicate_lines",
    "hidden internal": "hidden_internal_stack_lines",
    "truncated lines": "truncated_lines",
    "input tokens": "input_tokens",
    "output tokens": "output_tokens",
    "saved tokens": "saved_tokens",
}


def as_text(title: str = "reduction report") -> Column:
    """The block of one row: a title, a line for each number, the savings in percent with two digits. Null numbers show as 0."""
    width = max(map(len, SHOWN))
    lines = [F.concat(F.lit(f"  {label:<{width}} : "), F.coalesce(F.col(c), F.lit(0)).cast("string")) for label, c in SHOWN.items()]
    savings = F.concat(F.lit(f"  {'savings':<{width}} : "), F.format_string("%.2f%%", F.coalesce("savings_percent", F.lit(0.0))))
    return F.concat_ws("\n", F.lit(title), *lines, savings, F.lit(""))


def as_json(report: DataFrame) -> Column:
    """All columns of a row as one JSON object; nulls are written."""
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in report.columns)), {"ignoreNullFields": "false"})
