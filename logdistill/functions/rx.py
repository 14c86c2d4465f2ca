"""Regular expressions that mean in Java what they are written as: ASCII word
boundaries, all Unicode white space, and an end that is the very end."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"\s\x0b   -     　﻿"
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

BEFORE_WORD = "(?<![A-Za-z0-9_])"
_BEGINS = re.compile(r"(?:[A-Za-z0-9_]|\\d)(?![?*]|\{0|\{,)", re.ASCII)


def _begins_word(rest: str) -> bool:
    """If all that ``rest`` can match begins with an ASCII letter, digit or underscore: a plain one, or a group of choices that each begin with one."""
    if not rest.startswith("(?:"):
        return bool(_BEGINS.match(rest))
    depth, starts, i = 1, [3], 3
    while i < len(rest) and depth:
        c = rest[i]
        if c == "[":
            return False
        if c == "\\":
            i += 1
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "|" and depth == 1:
            starts.append(i + 1)
        i += 1
    return not rest[i : i + 1] in ("?", "*", "{") and all(_BEGINS.match(rest, at) for at in starts)


def java(pattern: str, flags: str = "") -> str:
    """``pattern`` with \\b, \\s, \\S, $ and . made strict; flags: i (letters of all scripts), m (^ and $ at each line) and s (. takes line ends too)."""
    ends = r"\n\r\x{2028}\x{2029}"
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i : i + 2]
        if c == "\\":
            if two == r"\b" and not in_class:
                out.append(BEFORE_WORD if _begins_word(pattern[i + 2 :]) else BOUNDARY)
            elif two == r"\s":
                out.append(BLANK if in_class else f"[{BLANK}]")
            elif two == r"\S" and not in_class:
                out.append(f"[^{BLANK}]")
            else:
                out.append(two)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
        elif c == "[":
            out.append(r"\[")
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        elif c == "$" and not in_class:
            out.append(rf"(?:\z|(?=[{ends}]))" if "m" in flags else r"\z")
        elif c == "^" and not in_class and "m" in flags:
            out.append(rf"(?:\A|(?<=[{ends}]))")
        elif c == "." and not in_class and "s" in flags:
            out.append(r"[\s\S]")
        elif c == "." and not in_class:
            out.append(r"[^\n\r  ]")
        else:
            out.append(c)
        i += 1
    return ("(?iu)" if "i" in flags else "") + "".join(out)


def matches(line: Column, pattern: str, flags: str = "") -> Column:
    return line.rlike(java(pattern, flags))


def replaced(line: Column, pattern: str, by: str, flags: str = "") -> Column:
    return F.regexp_replace(line, F.lit(java(pattern, flags)), F.lit(by))


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, f"^[{BLANK}]+|[{BLANK}]+\\z", "")


def is_blank(line: Column) -> Column:
    return ~line.rlike(f"[^{BLANK}]")


def words(line: Column) -> Column:
    """Number of runs of characters that aren't white space."""
    return F.regexp_count(line, F.lit(f"[^{BLANK}]+")).cast("long")


def apart(value: Column) -> Column:
    """``value`` in a projection that isn't fused into a whole stage: long chains of patterns would make one method that is too large to compile. Patterns take nearly all the time either way."""
    return F.element_at(F.transform(F.array(value), lambda x: x), 1)


def guarded(value: Column, test: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` of a value that passes ``test``, others as they are: for tests that cost less, and that all values which change pass. The value is named once, so chains stay short."""
    return F.element_at(F.transform(F.array(value), lambda x: F.when(test(x), change(x)).otherwise(x)), 1)


def having(pattern: str, flags: str = "") -> Callable[[Column], Column]:
    return lambda x: matches(x, pattern, flags)


def holding(*parts: str) -> Callable[[Column], Column]:
    """Lines that hold all of ``parts``."""
    return lambda x: reduce(and_, (x.contains(p) for p in parts))
