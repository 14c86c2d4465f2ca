"""Row-local tests and scores of a line."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logdistill.functions.rx import is_blank, java, matches, replaced, trimmed

# Patterns, scores and thresholds.
TAG = r"\[(?:ERROR|WARN|FATAL|CRITICAL|FAIL)\]"
ANY_TAG = r"\[[A-Z]+\]"
IGNORED_TAG = r'\[(?:INFO|DEBUG|TRACE|VERBOSE)\]|"level"\s*:\s*"(?:info|debug|trace|verbose)"'
ROUTINE_NOTICE = r"^(?:\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?\s+\d{4}\]|\[TIME\])\s+\[notice\]\s+(?:workerEnv\.init\(\) ok\b|jk2_init\(\) Found child \d+ in scoreboard slot \d+\b)"
DIAGNOSTIC = r"\b(?:Error|Exception|AssertionError|TypeError|ReferenceError|SyntaxError|RangeError|NullPointerException|Unhandled|failed|failure|fatal|panic|refused|timeout|timed\s+out|unreachable|unavailable|disconnected|killed|aborted|crashed|terminated|unauthorized)\b"
JSON_SEVERITY = r'"(?:level|severity)"\s*:\s*"(?:fatal|error|critical|warn|warning)"'
SCANNER = r"\b(?:CVE-\d{4}-\d{4,7}|GHSA-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4}|vulnerabilit(?:y|ies)|severity:\s*(?:critical|high|medium)|(?:critical|high)\s+severity)\b"
CONTAINER = r"\b(?:CrashLoopBackOff|ImagePullBackOff|ErrImagePull|OOMKilled|Back[- ]off restarting failed container|failed to pull image|(?:containerd|runc).*?(?:failed|error|panic|timeout|refused)|(?:failed|error|panic|timeout|refused).*?(?:containerd|runc)|rpc error: code = Unknown desc = failed to resolve reference)\b"
ANNOTATION = r"^::(?:error|warning|notice)\b"
GRADLE = r"\b(?:Execution failed|What went wrong|BUILD FAILED|Task failed with an exception)\b"
NPM, YARN = r"\b(?:npm|pnpm)\s+ERR!", r"\byarn\s+error\b"
GO_TEST, MAKE = r"---\s*FAIL:", r"^make[:\s*]+"
SYSTEMD = r"\b(?:Failed to start|Failed to load|Failed to listen|Failed to mount|Failed to open|Failed to connect|status=\d+\s+\w+)\b"
CIRCLECI = r"\b(?:Spin Cancelled|Step failed|job was not approved)\b"
JENKINS = r"\[(?:Pipeline|Checks|FCMaker)\]"
AZURE = r"^##vso\[task\.(?:LogIssue|Complete)\b"
TEAMCITY = r"^##teamcity\[(?:buildProblem|compilationFinished|message)\b"
JS_FRAME = r"^\s*at\s+.*(?:\(|\s).+:\d+:\d+\)?$"
JAVA_FRAME = r"^\s*at\s+[\w$_.<>/]+\([^)]+:\d+\)$"
PY_FRAME = r'^\s*File\s+"[^"]+",\s+line\s+\d+,\s+in\s+.+$'
GO_FRAME = r"^\s*(?:(?:[\w.-]+/)+[\w./-]+|[\w.-]+\.\(\*?[\w.]+\)\.[\w.]+|[\w.-]+\.[A-Z]\w*)\(.*\)$"
GO_FILE = r"^\s*(?:/[^\s]+|[A-Za-z]:[\\/][^\s]+):\d+(?:\s+\+\S+)?$"
GOROUTINE = r"^\s*goroutine\s+\d+\s+\[.+\]:$"
TRACEBACK = r"^Traceback \(most recent call last\):$"
MORE = r"^\s*\.\.\. \d+ more$"
INTERNAL = r"(?:node_modules[\\/]|node:internal|internal[\\/]modules|bootstrap_node|[\\/]usr[\\/]lib[\\/]|[\\/]usr[\\/]local[\\/]lib[\\/]|[\\/]usr[\\/]local[\\/]go[\\/]src[\\/]runtime[\\/]|site-packages[\\/]|dist-packages[\\/]|\.venv[\\/]|java\.base[\\/]|jdk\.internal|org\.springframework\.|[\\/]pkg[\\/]mod[\\/]|\.cargo[\\/]registry[\\/])"
#: (pattern, flags) of lines that look diagnostic.
DIAGNOSTICS = [
    (JS_FRAME, ""), (JAVA_FRAME, ""), (PY_FRAME, ""), (GO_FRAME, ""), (GO_FILE, ""), (GOROUTINE, "i"), (TRACEBACK, ""), (MORE, ""),
    (DIAGNOSTIC, "i"), (JSON_SEVERITY, "i"), (NPM, "i"), (YARN, "i"), (SCANNER, "i"), (CONTAINER, "i"), (ANNOTATION, ""), (GRADLE, "i"),
    (MAKE, ""), (GO_TEST, ""), (SYSTEMD, "i"), (CIRCLECI, "i"), (JENKINS, ""), (AZURE, ""), (TEAMCITY, ""),
]
#: (pattern, flags, score): all that match add up.
BOOSTERS = [
    (TAG, "i", 100), (JSON_SEVERITY, "i", 80), (SCANNER, "i", 70), (CONTAINER, "i", 70), (ANNOTATION, "", 70), (GRADLE, "i", 60),
    (NPM, "i", 60), (YARN, "i", 60), (DIAGNOSTIC, "i", 50), (GO_TEST, "", 50), (MAKE, "", 50), (SYSTEMD, "i", 50), (CIRCLECI, "", 50),
    (JENKINS, "", 40), (AZURE, "", 40), (TEAMCITY, "", 40), (r'\bHTTP/\d\.\d"\s+5\d{2}\b', "", 50), (r'\bHTTP/\d\.\d"\s+4\d{2}\b', "", 20),
    (JS_FRAME, "", 40), (JAVA_FRAME, "", 40), (PY_FRAME, "", 40), (GO_FRAME, "", 40), (GO_FILE, "", 40), (GOROUTINE, "i", 40),
    (TRACEBACK, "", 40), (MORE, "", 40),
]
TIMESTAMP_ONLY = r"^\s*(?:\d{4}[-/]\d{2}[-/]\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\s*)$"
NORMAL_EVENT = r"\b(?:type:\s*'?Normal'?|Normal\s+\d+[smhd])\b"
REPEATED = r"\b(?:(?:message|last message)\s+repeated\s+\d+\s+times?|\[\s*\d+\s*times?\s*\])"
PROGRESS_WORDS = r"\b(?:Error|error|fail|FAIL|crashed|timeout)\b"
SEPARATOR = r"^[=\-#]{20,}$"
PROGRESS = r"(?:(?:Downloading|Extracting|Pulling|Pushing|Fetching|Installing|Building|Receiving|Sending)[^\n]*?\d{1,3}%|\d{1,3}%\s*(?:[|][=#>-]+|(?:\d+\.?\d*\s*(?:[A-Za-z]+(?:/s)?|ETA|s\b))))"
PROGRESS_BAR = r"[|\[]\s*[=#>-]{5,}[>\s]*[|\]]"
CASCADE = r"(?:\baborting due to \d+ previous errors?\b|\bcould not compile\b[^\n]*\bdue to (?:\d+ )?previous errors?\b|\bdue to (?:\d+ )?previous errors?\b|\bcompilation terminated\b|(?:\bskipping|\bskipped)\b[^\n]*\bbecause\b[^\n]*\b(?:dependency|previous|upstream|prerequisite)\b[^\n]*\b(?:failed|error)|\bbecause (?:a |an |the )?(?:previous|prior|upstream|dependent|prerequisite) (?:step|task|job|stage|build|target|test|dependency) (?:failed|errored|was cancelled|did not complete)\b)"
FOREIGN = r"(?<!\p{L})(?:erreur|erreurs|errore|errori|erro|erros|fehler|fehlgeschlagen|falla|fallo|fall[oó]|fallido|fallida|fallito|fallita|falha|falhou|[ée]chec|[ée]chou[ée]|excepci[oó]n|exce[çc][aã]o|eccezione|ausnahme|cr[ií]tico|critique|kritisch|rechazado|recusado|refus[ée]|rifiutato|abgelehnt|agotado|esgotado|expir[ée]|scaduto|abgebrochen|impossible|imposible|ошибка|сбой|исключение|отказано|критическ\p{L}*|провал|сбои)(?!\p{L})"
FOREIGN_CJK = r"(?:错误|錯誤|失败|失敗|异常|異常|例外|严重|嚴重|致命|エラー|障害)"
SEVERITIES = {
    "fatal": r'\[FATAL\]|"level"\s*:\s*"fatal"|Severity:\s*FATAL|\bFATAL\b',
    "error": r'\[ERROR\]|"level"\s*:\s*"error"|Severity:\s*ERROR|\bERROR\b',
    "warn": r'\[WARN(?:ING)?\]|"level"\s*:\s*"warn(?:ing)?"|Severity:\s*WARN',
    "info": r'\[INFO\]|"level"\s*:\s*"info"|\bINFO\b',
    "debug": r'\[DEBUG\]|"level"\s*:\s*"debug"|\bDEBUG\b',
    "trace": r'\[TRACE\]|"level"\s*:\s*"trace"|\bTRACE\b',
}
RANKS = {"fatal": 5, "error": 4, "warn": 3, "info": 2, "debug": 1, "trace": 0}
_METHOD = r'^\S+\s+\S+\s+\S+\s+\[.+\]\s+"(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|CONNECT|TRACE)\s+(\S+)\s+HTTP/\d\.\d"\s+(\d{3})'
ACCESS = _METHOD + r"\b"
ACCESS_FULL = _METHOD + r'\s+\d+\s+"[^"]*"\s+"([^"]*)"'
NOISE_PATHS = [
    r"/(?:healthz|readyz|livez|health|ping|status|up)$",
    r"/(?:metrics|metricz)$",
    r"/(?:favicon\.ico|robots\.txt)$",
    r"\.(?:css|js|mjs|cjs|svg|ico|png|jpe?g|gif|webp|woff2?|ttf|eot|otf|map|txt|xml|json|webmanifest|wasm)(?:\?.*)?$",
]
NOISE_AGENTS = r"\b(?:ELB-HealthChecker|GoogleHC|kube-probe|node-fetch|Go-http-client|curl|wget|Prometheus)\b"
KEEP_SCORE, REPEATS_FREE, REPEAT_PENALTY = 40, 3, 8
LEVELS = ("low", "medium", "high", "aggressive")
LABELS = "attempt batch child chunk connection epoch iteration job partition pid replica retry session shard slot state task thread worker".split()
LOGFMT, SYSLOG, JSON_LINE = r"^\s*\w+=[^\s=]+(?:\s+\w+=[^\s=]+)*\s*$", r"^<\d{1,3}>\d?\s", r"^\s*\{.+\}\s*$"
LEVEL_KEYS, ERROR_KEYS = ("level", "severity", "lvl", "log_level"), ("err", "error", "exception")


def any_of(line: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a | b, (matches(line, p, f) for p, f in patterns), F.lit(False))


def is_ignored(line: Column) -> Column:
    return any_of(line, [(IGNORED_TAG, "i"), (ROUTINE_NOTICE, "i")])


def is_diagnostic(line: Column) -> Column:
    return any_of(line, DIAGNOSTICS)


def is_internal_frame(line: Column) -> Column:
    return ~matches(line, TAG, "i") & matches(line, INTERNAL, "i") & is_diagnostic(line)


def should_keep(line: Column) -> Column:
    shown = matches(line, TAG, "i") | (~matches(line, ANY_TAG, "i") & is_diagnostic(line))
    return ~is_blank(line) & ~is_ignored(line) & shown


def is_ci_noise(line: Column) -> Column:
    return matches(line, TIMESTAMP_ONLY) | (matches(line, "normal", "i") & matches(line, NORMAL_EVENT, "i")) | (matches(line, r"repeated|times?\s*\]", "i") & matches(line, REPEATED, "i"))


def is_progress(line: Column) -> Column:
    bar = (matches(line, r"[=\-#]{20}") & matches(trimmed(line), SEPARATOR)) | (line.contains("%") & matches(line, PROGRESS)) | matches(line, PROGRESS_BAR)
    return bar & ~is_blank(line) & ~matches(line, PROGRESS_WORDS)


def is_cascade(line: Column) -> Column:
    return matches(line, r"due to|terminated|because", "i") & matches(line, CASCADE, "i")


def is_foreign_diagnostic(line: Column) -> Column:
    return any_of(line, [(FOREIGN, "i"), (FOREIGN_CJK, "")])


def severity(line: Column) -> Column:
    return F.coalesce(*(F.when(matches(line, p, "i"), F.lit(name)) for name, p in SEVERITIES.items()))


def below_severity(line: Column, least: str) -> Column:
    rank = F.coalesce(*(F.when(matches(line, p, "i"), F.lit(RANKS[name])) for name, p in SEVERITIES.items()))
    return F.coalesce(rank < RANKS[least], F.lit(False))


def access_log(line: Column) -> Column:
    """struct(path, status, user_agent) of a full access-log line, or null."""
    rx = F.lit(java(ACCESS_FULL, "i"))
    parts = [F.regexp_extract(line, java(ACCESS_FULL, "i"), i) for i in (1, 2, 3)]
    return F.when(line.contains('"') & F.regexp_like(line, rx), F.struct(parts[0].alias("path"), parts[1].cast("int").alias("status"), parts[2].alias("user_agent")))


def is_access_log(line: Column) -> Column:
    return matches(line, ACCESS, "i")


def http_status(line: Column) -> Column:
    return F.coalesce(F.regexp_extract(line, java(ACCESS, "i"), 2).try_cast("int"), F.lit(0))


def is_access_noise(line: Column) -> Column:
    def noise(hit: Column) -> Column:
        quiet = any_of(hit["path"], [(p, "i") for p in NOISE_PATHS]) | matches(hit["user_agent"], NOISE_AGENTS, "i")
        return F.coalesce((hit["status"] < 400) & quiet, F.lit(False))

    return F.element_at(F.transform(F.array(access_log(line)), noise), 1)


def base_score(line: Column, level: str = "high") -> Column:
    """Sum of the boosters, with the rules of the levels aggressive and low; -inf for blank and ignored lines."""
    total = reduce(lambda a, b: a + b, (F.when(matches(line, p, f), n).otherwise(0) for p, f, n in BOOSTERS))
    if level == "aggressive":
        total = F.when(matches(line, r"\[(?:WARN|WARNING)\]", "i") & ~matches(line, DIAGNOSTIC, "i"), -1).otherwise(total)
    if level == "low":
        total = total + F.when(matches(line, r"\[(?:NOTICE|STATUS)\]", "i"), 30).otherwise(0)
    return F.when(is_blank(line) | is_ignored(line), F.lit(float("-inf"))).otherwise(total.cast("double"))


def repeat_penalty(seen: Column) -> Column:
    return F.when(seen >= REPEATS_FREE, REPEAT_PENALTY * (seen - REPEATS_FREE + 1)).otherwise(0)


def detect_format(line: Column) -> Column:
    valid = F.try_parse_json(line).isNotNull()
    return (
        F.when(matches(line, SYSLOG), "syslog").when(matches(line, JSON_LINE) & valid, "json").when(matches(line, LOGFMT), "logfmt").otherwise("unknown")
    )


def json_level(line: Column) -> Column:
    """Level of a JSON object: that of the first key it has, numbers named; info without one; null if it isn't JSON."""
    v = F.try_parse_json(line)
    text = F.try_variant_get
    out = F.lit("info")
    for key in reversed(LEVEL_KEYS):
        kind = F.schema_of_variant(text(v, f"$.{key}", "variant"))
        number = text(v, f"$.{key}", "double")
        named = F.when(number >= 60, "fatal").when(number >= 50, "error").when(number >= 40, "warn").when(number >= 30, "info").when(number >= 20, "debug").otherwise("trace")
        told = F.when(kind == "STRING", F.lower(text(v, f"$.{key}", "string"))).when(kind.isin("VOID", "BOOLEAN") | kind.startswith("OBJECT") | kind.startswith("ARRAY"), "info").otherwise(named)
        out = F.when(kind.isNotNull(), told).otherwise(out)
    return F.when(v.isNotNull() & line.rlike(r"^\s*[\[{]"), out)


def json_score(line: Column) -> Column:
    """100, 50 or 80 for lines worth keeping, -1 for JSON to drop, null for what isn't JSON."""
    level = json_level(line)
    v = F.try_parse_json(line)
    stack = reduce(lambda a, b: a | b, (F.coalesce(F.length(F.try_variant_get(v, f"$.{k}.stack", "string")) > 0, F.lit(False)) for k in ERROR_KEYS))
    return F.when(level.isin("fatal", "error", "critical"), 100).when(level.isin("warn", "warning"), 50).when(level.isNotNull() & stack, 80).when(level.isNotNull(), -1)


def tokens_of_words(n: Column) -> Column:
    return F.ceil(n * F.lit(1.3))


def tokens_of_text(text: Column) -> Column:
    wide = F.regexp_count(text, F.lit(r"[　-鿿가-힯＀-￯]"))
    units = F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10ffff}]"))
    return F.ceil(wide + (units - wide) / 4)


def repeat_tokens(line: Column) -> Column:
    """array<struct<prefix, value, token>>: value is null for what doesn't vary between repeats."""
    pieces = F.split(trimmed(line), java(r"\s+"))

    def cut(t: Column, i: Column) -> Column:
        pair = t.rlike(r"^[^=]+=[\s\S]+\z")
        number = t.rlike(r"^\d+(?:[.:,-]\d+)*\z") & F.coalesce(F.lower(F.get(pieces, i - 1)).isin(LABELS), F.lit(False))
        prefix = F.when(pair, F.regexp_extract(t, r"^([^=]+=)", 1)).otherwise("")
        value = F.when(pair, F.regexp_extract(t, r"^[^=]+=([\s\S]+)\z", 1)).when(number, t)
        return F.struct(prefix.alias("prefix"), value.alias("value"), t.alias("token"))

    return F.transform(pieces, cut)


def repeat_signature(line: Column) -> Column:
    return F.array_join(
        F.transform(repeat_tokens(line), lambda x: F.when(x["value"].isNotNull(), F.concat(x["prefix"], F.lit("[VALUE]"))).otherwise(x["token"])), " "
    )


def continues(line: Column, mode: str) -> Column:
    """If a line goes on the one before, in a multiline mode."""
    indented = matches(line, r"^\s+") & ~line.startswith("    [")
    rules = {
        "off": F.lit(False),
        "java": indented | matches(line, r"^Caused\s+by:", "i"),
        "go": matches(line, r"^(?:\t|goroutine\s+\d+\s+\[.+\]:|created\s+by\s)"),
        "auto": indented | matches(line, r"^Caused\s+by:", "i") | matches(line, r"^goroutine\s+\d+\s+\[.+\]:"),
    }
    return ~is_blank(line) & rules.get(mode, indented)
