"""Masking of times, addresses, secrets and ids, as an ordered chain of replacements."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logdistill.functions.rx import guarded, having, holding, java, replaced

# The formats that are masked, in the order in which they are.
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_DAY, _MONTH = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)", "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
UUID = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
TIMES = [
    (rf"\b{_DAY},?\s+\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\s+\d{{2}}:\d{{2}}:\d{{2}}\s+(?:GMT|UTC)\b", "i"),
    (rf"\[{_DAY}\s+{_MONTH}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}(?:\.\d{{1,9}})?\s+\d{{4}}\]", "i"),
    (rf"\b\d{{1,2}}/{_MONTH}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}\s+[+-]\d{{4}}\b", "i"),
    (r"\b\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2}\b", ""),
    (r"\b\d{4}-\d{2}-\d{2}(?:[T\s]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?)?\b", ""),
]
ADDRESSES = [
    (rf"\b{_OCTET}(?:\.{_OCTET}){{3}}:(?:6553[0-5]|655[0-2]\d|65[0-4]\d{{2}}|6[0-4]\d{{3}}|[1-5]?\d{{1,4}})\b", "[IP]:[PORT]"),
    (rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b", "[IP]"),
    (
        r"(?:(?:[0-9a-fA-F]{1,4}:){2,}:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})*|(?:[0-9a-fA-F]{1,4}:){4,}[0-9a-fA-F]{1,4}|::[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})+)",
        "[IPV6]",
    ),
]
CONNECTION = r"(\b(?:postgres|mysql|mongodb|redis|postgresql|sqlserver|jdbc)://[^:@\s]+:)([^@\s]+)@"
TOKENS = [
    (r"\bgh[opuars]_[A-Za-z0-9]{36,255}\b", "[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]{16,2000}\.[A-Za-z0-9_-]{16,2000}\.[A-Za-z0-9_-]{16,2000}\b", "[JWT]"),
    (r"\bxox[abprs]-\d{10,12}-\d{10,12}-[A-Za-z0-9]{24,}\b", "[REDACTED]"),
    (r"\b(?:sk|pk|rk)_(?:live|test)_[0-9A-Za-z]{24,99}\b", "[REDACTED]"),
    (r"\bnpm_[A-Za-z0-9]{36,80}\b", "[REDACTED]"),
    (r"\bAIza[0-9A-Za-z_-]{30,40}\b", "[REDACTED]"),
    (r"\b(?:SK|AC)[a-f0-9]{32}\b", "[REDACTED]"),
    (r"\bSG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{32,64}\b", "[REDACTED]"),
]
AUTHORIZATION = r"\bAuthorization\s*:\s*\S+(?:\s+\S+)*"
SECRET_FIELD = r"(\b(?:password|secret|token|api[_-]?key|api[_-]?secret|private[_-]?key|client[_-]?secret|access[_-]?token|refresh[_-]?token|auth[_-]?token|bearer)\s*[:=]\s*)\S+"
DURATION = r"\b(?:\d+d)?(?:\d+h)?(?:\d+m)?\d+s\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}\b"
HEX_HASH = r"\b(?=[a-f0-9]*\d)(?=[a-f0-9]*[a-f])[a-f0-9]{16,128}\b"
WORD_HASH = r"\b(?=[A-Za-z0-9]*\d)(?=[A-Za-z0-9]*[A-Za-z])[A-Za-z0-9]{24,512}\b"
AWS_KEY = r"\b(?:AKIA|ABIA|ASIA)[0-9A-Z]{16}\b"
ARN = r"(arn:aws:[a-z0-9-]+:[a-z0-9-]+:)\d{12}"
STATUS_CONTEXT = r"(\b(?:HTTP\s*/?\d?(?:\.\d+)?\s+|status[=:\s]+|returned\s+|responded\s+with\s+|got\s+|received\s+|with\s+status\s+|code[=:\s]+)\s*)"
STATUS_PHRASE = r"(\s+(?:OK|Created|Accepted|No Content|Moved|Found|Not Modified|Bad Request|Unauthorized|Forbidden|Not Found|Method Not Allowed|Conflict|Gone|Too Many Requests|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout)\b)"
PEM_HEADER = r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED |)PRIVATE KEY-----"
PEM_FOOTER = r"-----END (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED |)PRIVATE KEY-----"
PEM_MARKER = "[PEM PRIVATE KEY REDACTED]"


def _suffixed(pattern: str, name: str, keep: int, line: Column, flags: str = "") -> Column:
    if keep <= 0:
        return replaced(line, pattern, f"[{name}]", flags)
    # The look-behind finds where the match ended, and the group is its last characters.
    tail = f"(?:{java(pattern)})(?<=([\\s\\S]{{{keep}}}))"
    return F.regexp_replace(line, F.lit(("(?iu)" if "i" in flags else "") + tail), F.lit(f"[{name}:$1]"))


def group_status_codes(line: Column) -> Column:
    """4xx and 5xx after a word that announces a status, then before a reason phrase; others stay."""
    for code, name in ((r"[5-9]\d\d", "5xx"), (r"4\d\d", "4xx")):
        line = replaced(line, STATUS_CONTEXT + code + r"\b", f"$1[HTTP {name}]", "i")
    for code, name in ((r"[5-9]\d\d", "5xx"), (r"4\d\d", "4xx")):
        line = replaced(line, rf"\b{code}" + STATUS_PHRASE, f"[HTTP {name}]$1", "i")
    return line


#: For each of TIMES, what every match holds.
_TIME_PARTS = [having(r"GMT|UTC", "i"), holding("["), holding("/"), having(r"\d/\d\d/\d"), having(r"\d-\d\d-\d")]
_CLOCK = r"\d\d:\d\d:\d\d|\d{4}-\d\d-\d\d"
_TOKEN_STARTS = r"gh[opuars]_|eyJ|xox[abprs]-|[spr]k_(?:live|test)_|npm_|AIza|(?:SK|AC)[a-f0-9]{32}|SG\."


def _times(line: Column) -> Column:
    for (pattern, flags), test in zip(TIMES, _TIME_PARTS):
        line = guarded(line, test, lambda x, p=pattern, f=flags: replaced(x, p, "[TIME]", f))
    return line


def _each(rules: list[tuple[str, str]]) -> Callable[[Column], Column]:
    return lambda x: reduce(lambda line, rule: replaced(line, *rule), rules, x)


def sanitize(line: Column, keep_suffix: int = 0) -> Column:
    """All masks in order; ``keep_suffix`` last characters of ids and hashes may stay. Each mask runs on lines that hold what all its matches hold."""
    steps = [
        (holding("\x1b"), lambda x: replaced(x, r"\x1b\[[0-9;]*m", "")),
        (having(r"-[0-9a-f]{4}-[0-9a-f]{4}-", "i"), lambda x: _suffixed(UUID, "ID", keep_suffix, x, "i")),
        (having(_CLOCK), _times),
        (having(r"\d\.\d{1,3}\.\d{1,3}\.\d"), _each(ADDRESSES[:2])),
        (having(r"::|:(?:[0-9a-fA-F]{1,4}:){3}"), _each(ADDRESSES[2:])),
        (holding("://", "@"), lambda x: replaced(x, CONNECTION, "$1[REDACTED]@", "i")),
        (having(_TOKEN_STARTS), _each(TOKENS)),
        (having(r"Authorization\s*:", "i"), lambda x: replaced(x, AUTHORIZATION, "Authorization: [REDACTED]", "i")),
        (having(r"(?:password|secret|token|key|bearer)\s*[:=]", "i"), lambda x: replaced(x, SECRET_FIELD, "$1[REDACTED]", "i")),
        (having(r"\ds"), lambda x: replaced(x, DURATION, "[AGO]")),
        (holding("@"), lambda x: replaced(x, EMAIL, "[EMAIL]")),
        (having(r"[a-f0-9]{16}", "i"), lambda x: _suffixed(HEX_HASH, "HASH", keep_suffix, x, "i")),
        (having(r"[A-Za-z0-9]{24}"), lambda x: _suffixed(WORD_HASH, "HASH", keep_suffix, x)),
        (having(r"A[BKS]IA"), lambda x: replaced(x, AWS_KEY, "[REDACTED]")),
        (holding("arn:aws:"), lambda x: replaced(x, ARN, "$1[ACCOUNT]")),
        (having(r"[ \t]$"), lambda x: replaced(x, r"[ \t]+$", "")),
        (having(r"[4-9]\d\d"), group_status_codes),
    ]
    return reduce(lambda x, step: guarded(x, *step), steps, line)


def custom_mask(line: Column, pattern: str, by: str, flags: str = "g") -> Column:
    """A rule of the user's; without g only the first match is replaced."""
    if "g" in flags:
        return replaced(line, pattern, by, flags)
    first = "(?s)^(.*?)(?-s:" + java(pattern, flags.replace("i", "")) + ")"
    shifted = "$1" + "".join(f"${int(c) + 1}" if i and by[i - 1] == "$" and c.isdigit() else c for i, c in enumerate(by) if not (c == "$" and by[i + 1 : i + 2].isdigit()))
    return F.regexp_replace(line, F.lit(("(?iu)" if "i" in flags else "") + first), F.lit(shifted))


def frame_numbers(line: Column) -> Column:
    """Line and column numbers of stack frames as [NN]: Python, Go, JavaScript, Java."""
    line = replaced(line, r"(, line )\d+(, in )", "$1[NN]$2")
    line = replaced(line, r":\d+(\s+\+0x[0-9a-f]+)", ":[NN]$1")
    line = replaced(line, r":\d+:\d+\)", ":[NN]:[NN])")
    return replaced(line, r":\d+(?=\))", ":[NN]")


def stack_signature(line: Column) -> Column:
    """What repeats of a stack trace have in common, or null for other lines."""
    trace = java(r'(?:^|\n)\s*(?:at\s+\S|File\s+"[^"]+",\s+line\s+\d+|goroutine\s+\d+\s+\[|Traceback \(most recent call last\):)')
    out = replaced(frame_numbers(line), r"\+0x[0-9a-f]+", "+0x[NN]", "i")
    out = replaced(out, r"\bgoroutine\s+\d+\b", "goroutine [NN]", "i")
    return F.when(line.rlike(trace), replaced(out, r"\b0x[0-9a-f]+\b", "0x[NN]", "i"))
