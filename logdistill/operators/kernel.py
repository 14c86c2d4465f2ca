"""The steps of a stream that feed back on themselves, as one fold over scored rows.

Everything that a row alone decides is a column before this; the fold keeps
counters, short queues and what was seen, and never looks at raw text again.
Batch and streaming jobs use the same fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter, OrderedDict, deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from logdistill.functions.lines import KEEP_SCORE, LABELS, LEVELS, REPEAT_PENALTY, REPEATS_FREE
from logdistill.functions.masks import PEM_MARKER

# What is written, and the sizes of windows.
HIDDEN = "[... hidden internal library frames ...]"
UNTERMINATED = "[PEM block unterminated - input redacted]"
BEFORE, AFTER, DENSE, SPARSE, WIDER = 3, 2, 2, 12, 2
LEVEL_WINDOW, SAMPLE, SHOWN_VALUES, TOP = 8, 50, 3, 9007199254740991
_BLANK = re.compile(r"\s+")
_NUMBER = re.compile(r"^\d+(?:[.:,-]\d+)*\Z", re.ASCII)
_STAMP = re.compile(r"\b(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z?)\b", re.ASCII)


@dataclass
class Options:
    """What a caller can choose. Defaults are those of a plain run."""

    aggressiveness: str = "auto"
    context_before: int = BEFORE
    context_after: int = AFTER
    adaptive_context: bool | None = None
    dedupe: bool = True
    dedupe_window: int = 1
    collapse_stacks: bool = True
    collapse_blocks: int | None = None
    max_tokens: int | None = None
    sample_size: int | None = None
    format_sample: int = SAMPLE
    preserve_jsonl: bool = False
    multiline: str = "off"
    severity: str | None = None
    include: str | None = None
    exclude: str | None = None
    root_cause: bool = True
    multilingual: bool = True
    keep_id_suffix: int = 0
    max_line_length: int = 100_000
    diagnostics: list[str] = field(default_factory=list)
    ignores: list[str] = field(default_factory=list)
    sanitizers: list[tuple[str, str, str]] = field(default_factory=list)
    internals: list[str] = field(default_factory=list)
    #: source -> markers, joined to those of the catalogue.
    sources: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self):
        if self.aggressiveness not in (*LEVELS, "auto"):
            raise ValueError(f"unknown aggressiveness: {self.aggressiveness}")
        if self.multiline not in ("off", "auto", "auto-source", "python", "node", "java", "go", "rust"):
            raise ValueError(f"unknown multiline mode: {self.multiline}")

    @property
    def adaptive(self) -> bool:
        return self.aggressiveness == "auto" if self.adaptive_context is None else self.adaptive_context


def variable(token: str | None, before: str | None) -> tuple[str, str] | None:
    """(prefix, value) of a token whose value may vary between repeats."""
    if token is None:
        return None
    at = token.find("=")
    if 0 < at < len(token) - 1:
        return token[: at + 1], token[at + 1 :]
    if before is not None and before.lower() in LABELS and _NUMBER.match(token):
        return "", token
    return None


def tokens(line: str) -> list[str]:
    return _BLANK.split(line.strip())


def signature(line: str) -> str:
    ts = tokens(line)
    found = [variable(t, ts[i - 1] if i else None) for i, t in enumerate(ts)]
    return " ".join(t if v is None else f"{v[0]}[VALUE]" for t, v in zip(ts, found))


def stamp_ms(line: str) -> float | None:
    m = _STAMP.search(line)
    if not m:
        return None
    try:
        when = datetime.fromisoformat(m[1].replace("Z", "+00:00"))
    except ValueError:
        return None
    return (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).timestamp() * 1000


class Group:
    """Lines of one signature: the first, how many, and up to three values at each place that varies. The first is taken apart when a second comes."""

    def __init__(self, line: str, score: float):
        self.line, self.score, self.count = line, score, 1

    def _part(self) -> None:
        line = self.line
        self.tokens = tokens(line)
        self.slots = {i: v for i, t in enumerate(self.tokens) if (v := variable(t, self.tokens[i - 1] if i else None))}
        self.values: dict[int, OrderedDict] = {}
        self.more: set[int] = set()
        self.first = self.last = stamp_ms(line)

    def add(self, line: str, score: float) -> None:
        if self.count == 1:
            self._part()
        ts = tokens(line)
        self.count, self.score = self.count + 1, max(self.score, score)
        for i, (prefix, value) in self.slots.items():
            now = variable(ts[i], ts[i - 1] if i else None) if i < len(ts) else None
            if now is None or now[0] != prefix or now[1] == value:
                continue
            held = self.values.setdefault(i, OrderedDict({value: None}))
            if now[1] not in held:
                if len(held) < SHOWN_VALUES:
                    held[now[1]] = None
                else:
                    self.more.add(i)
        at = stamp_ms(line)
        if at is not None:
            self.last = at if self.last is None else max(self.last, at)

    def render(self) -> str:
        if self.count == 1:
            return self.line
        shown = list(self.tokens)
        for i, held in self.values.items():
            shown[i] = f"{self.slots[i][0]}[{' | '.join([*held, *['…'] * (i in self.more)])}]"
        spread = self.last - self.first if self.first is not None and self.last is not None else 0
        tail = ""
        if spread > 5000:
            unit, name = next((u, n) for limit, u, n in ((60_000, 1000, "s"), (3_600_000, 60_000, "m"), (math.inf, 3_600_000, "h")) if spread < limit)
            tail = f" [~{math.floor(spread / unit + 0.5)}{name}]"
        return f"[x{self.count}] {' '.join(shown)}{tail}"


class Level:
    """Aggressiveness that follows blocks of eight decisions when it is auto."""

    def __init__(self, wanted: str):
        self.auto = wanted == "auto"
        self.now = "high" if self.auto else wanted
        self.block: list[tuple[bool, bool, bool, bool]] = []

    def note(self, kept: bool, dropped: bool, hard: bool, repeated: bool) -> None:
        if not self.auto:
            return
        self.block.append((kept, dropped, hard, repeated))
        if len(self.block) < LEVEL_WINDOW:
            return
        n_kept, n_dropped, n_hard, n_repeated = (sum(x) for x in zip(*self.block))
        self.block = []
        by = -1 if n_hard >= 3 else 1 if n_kept <= 1 and n_dropped + n_repeated >= 6 else 0
        self.now = LEVELS[min(len(LEVELS) - 1, max(0, LEVELS.index(self.now) + by))]


def collapse_blocks(lines: list[str], longest: int) -> list[int | str]:
    """Indices of lines that stay and ``[block xN]`` marks; at each place the longest block that repeats at once is folded."""
    n, at, out = len(lines), 0, []
    while at < n:
        for size in range(min(max(2, longest), (n - at) // 2), 1, -1):
            times = 1
            while lines[at + times * size : at + (times + 1) * size] == lines[at : at + size]:
                times += 1
            if times > 1:
                out += [*range(at, at + size), f"[block x{times}]"]
                at += size * times
                break
        else:
            out.append(at)
            at += 1
    return out


def within_budget(scores: list[float], costs: list[int], most: float) -> list[int]:
    """Indices that fit: by score, then by place; what doesn't fit is passed over. All stay if all fit."""
    left = max(0, math.floor(most))
    if sum(costs) <= left:
        return list(range(len(costs)))
    chosen = []
    for i in sorted(range(len(costs)), key=lambda i: (-scores[i], i)):
        if costs[i] <= left:
            left -= costs[i]
            chosen.append(i)
    return sorted(chosen)


def cost(text: str) -> int:
    return math.ceil(len(text.split()) * 1.3)


class Reducer:
    """Fold of one stream. ``push`` takes rows in order; ``close`` ends the stream; outputs collect in ``out``, decisions in ``decisions``."""

    def __init__(self, options: Options, estimate: Callable[[str], float] | None = None):
        self.o, self.estimate = options, estimate
        self.level = Level(options.aggressiveness)
        self.out: list[tuple[str, float]] = []
        self.decisions: list[tuple] = []
        self.stats: Counter = Counter()
        self.format: str | None = None
        self.votes: Counter = Counter()
        self.sampled, self.voted = 0, False
        self.seen: Counter = Counter()
        self.groups: OrderedDict[str, Group] = OrderedDict()
        self.ring: deque[str] = deque()
        self.burst: list | None = None
        self.left, self.in_pem, self.in_frames, self.emitted = 0, False, False, 0
        self.gap = (DENSE + SPARSE) // 2

    def price(self, text: str) -> int:
        """Tokens of a line of output."""
        return max(0, math.ceil(self.estimate(f"{text}\n"))) if self.estimate else cost(text)

    # What goes out.
    def _emit(self, text: str, score: float) -> None:
        if self.o.sample_size is not None and self.emitted >= self.o.sample_size:
            self.stats["dropped_lines"] += text.count("\n") + 1
            self._decide(None, text, "sample-limit", False, True)
            return
        self.emitted += 1
        self.out.append((text, score))

    def _flush_group(self) -> None:
        _, g = self.groups.popitem(last=False)
        self.stats["duplicate_lines"] += g.count - 1
        self._emit(g.render(), g.score)

    def _offer(self, text: str, score: float, key: str | None = None) -> None:
        if not self.o.dedupe or self.o.preserve_jsonl:
            self._emit(text, score)
            return
        key = signature(text) if key is None else key
        if key in self.groups:
            self.groups[key].add(text, score)
            return
        self.groups[key] = Group(text, score)
        if len(self.groups) > self.o.dedupe_window:
            self._flush_group()

    def _decide(self, line, text, reason, kept, dropped, hard=False, repeated=False, score=None) -> None:
        self.decisions.append((line, text, reason, kept, dropped, hard, repeated, score))
        self.level.note(kept, dropped, hard, repeated)

    def _drop(self, row, reason: str) -> None:
        self.stats["dropped_lines"] += row.n_lines
        self.in_frames = False
        self._decide(row.line_no, None, reason, False, True)

    # Context.
    def _burst_text(self) -> str:
        text, _, n = self.burst
        return f"[x{n} access-log 2xx] {text}" if n > 1 else text

    def _flush_context(self) -> None:
        if self.burst:
            self.ring.append(self._burst_text())
            self.burst = None
        while self.ring:
            self._offer(self.ring.popleft(), 0.0)

    def _open(self) -> None:
        self._flush_context()
        base = self.o.context_after
        if not self.o.adaptive:
            self.left = base
        else:
            self.left = max(1, base - 1) if self.gap <= DENSE else base + WIDER if self.gap >= SPARSE else base
        self.gap = 0

    def _buffer(self, row, text: str) -> bool:
        """Puts a line in the ring; True if an older one left it."""
        full = len(self.ring) >= self.o.context_before
        if full:
            self.ring.popleft()
            self.stats["dropped_lines"] += 1
        if self.format == "json":
            self.ring.append(text)
        elif row.quiet_path is None:
            if self.burst:
                self.ring.append(self._burst_text())
                self.burst = None
            self.ring.append(text)
        elif self.burst and self.burst[1] == row.quiet_path:
            self.burst[2] += 1
        else:
            if self.burst:
                self.ring.append(self._burst_text())
            self.burst = [text, row.quiet_path, 1]
        return full

    # Format.
    def _majority(self) -> str | None:
        known = Counter({k: v for k, v in self.votes.items() if k != "unknown"})
        if not known or self.sampled < 2:
            return None
        return known.most_common(1)[0][0]

    def _vote(self, fmt: str) -> None:
        if self.voted:
            return
        if self.format is None and fmt != "unknown":
            self.format = fmt
        self.sampled += 1
        self.votes[fmt] += 1
        if self.sampled >= self.o.format_sample:
            self.voted = True
            self.format = self._majority() or self.format

    def push(self, row) -> None:
        s = self.stats
        s["input_lines"] += row.n_lines
        s["input_words"] += row.words
        s["input_bytes"] += row.bytes
        if self.estimate:
            s["input_tokens"] += max(0, math.ceil(self.estimate(f"{row.value}\n")))
        if row.reason == "empty":
            s["dropped_lines"] += row.n_lines
            self._decide(row.line_no, None, "empty", False, True)
            return
        self._vote(row.fmt)
        self.gap += 1
        if row.truncated and row.reason not in ("include-filter", "exclude-filter"):
            s["truncated_lines"] += 1
        if row.reason is not None:
            return self._drop(row, row.reason)
        text, internal, frames, norm = row.sanitized, row.internal, row.stack_key, row.score
        if row.pem == "header":
            self.in_pem = True
            text, internal, frames, norm = PEM_MARKER, False, None, 0.0
        elif self.in_pem:
            if row.pem == "footer":
                self.in_pem = False
            return self._drop(row, "custom-ignore")
        as_json = self.format == "json"
        if internal and not (as_json and text.startswith("{")):
            s["hidden_internal_stack_lines"] += row.n_lines
            if not self.in_frames:
                self._flush_context()
                self._offer(HIDDEN, float(KEEP_SCORE))
                self.in_frames, self.left = True, 0
            self._decide(row.line_no, HIDDEN, "internal-stack", True, False)
            return
        self.in_frames = False
        self.seen[text] += 1
        n = self.seen[text]
        again = n > 1
        key = frames if self.o.collapse_stacks and frames is not None else None
        if as_json and row.json_score is not None:
            if row.json_score < 0:
                return self._drop(row, "ignored-tag")
            if row.json_score >= 80:
                self._open()
                self._offer(text, float(row.json_score), key)
                self._decide(row.line_no, text, "hard-keep", True, False, False, False, float(row.json_score))
                return
            score = float(row.json_score)
        else:
            score = norm
            if self.level.now == "aggressive" and row.quiet_warn:
                score = -1.0
            if self.level.now == "low" and row.notice:
                score += 30
            if n >= REPEATS_FREE:
                score -= REPEAT_PENALTY * (n - REPEATS_FREE + 1)
        score += row.extra
        if score >= KEEP_SCORE:
            self._open()
            self._offer(text, score, key)
            self._decide(row.line_no, text, "hard-keep", True, False, True, again, score)
        elif self.left > 0:
            self._offer(text, score, key)
            self.left -= 1
            self._decide(row.line_no, text, "after-context", True, False, False, again, score)
        elif score >= 0 and self.o.context_before > 0:
            evicted = self._buffer(row, text)
            self._decide(row.line_no, text, "context-buffered", False, evicted, False, again, score)
        else:
            s["dropped_lines"] += row.n_lines
            reason = "context-disabled" if score >= 0 else "low-score"
            self._decide(row.line_no, text, reason, False, True, False, again, score)

    def close(self) -> list[tuple[str, float]]:
        """Ends the stream and returns all output lines with their scores."""
        s = self.stats
        s["dropped_lines"] += len(self.ring)
        self.ring.clear()
        if not self.voted and self.format is None:
            self.format = self._majority()
        if self.in_pem:
            s["output_words"] += len(UNTERMINATED.split())
            s["output_bytes"] += len(UNTERMINATED) + 1
            s["truncated_lines"] += 1
            self._emit(UNTERMINATED, float(TOP))
        while self.groups:
            self._flush_group()
        lines = self.out
        if self.o.collapse_blocks is not None:
            texts = [t for t, _ in lines]
            plan = collapse_blocks(texts, self.o.collapse_blocks)
            s["duplicate_lines"] += len(texts) - sum(isinstance(x, int) for x in plan)
            lines = [lines[x] if isinstance(x, int) else (x, 0.0) for x in plan]
        if self.o.max_tokens is not None:
            stay = within_budget([x for _, x in lines], [self.price(t) for t, _ in lines], self.o.max_tokens)
            gone = set(range(len(lines))).difference(stay)
            s["dropped_lines"] += sum(lines[i][0].count("\n") + 1 for i in gone)
            lines = [lines[i] for i in stay]
        for text, _ in lines:
            s["output_lines"] += text.count("\n") + 1
            s["output_words"] += len(text.split())
            s["output_bytes"] += len(text.encode("utf-8", "replace")) + 1
            if self.estimate:
                s["output_tokens"] += self.price(text)
        self.out = lines
        return lines

    def run(self, rows: Iterable) -> Reducer:
        for row in rows:
            self.push(row)
        self.close()
        return self
