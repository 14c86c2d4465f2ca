"""Logical lines by one pass over sorted lines, for what windows can't say: where a group ends depends on where those before it ended."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd

from logdistill.operators.catalog import MODES

# The most lines of a group, and the bytes from which on it takes no more.
GROUP_LINES, GROUP_BYTES = 200, 200_000
#: Rules by which a line can go on the one before; a line's ``goes`` has a bit for each.
RULES = ("auto", "plain", "java", "go")
CUT = "stream_id string, line_no long, value string, n_lines int"


def rule_of(mode: str) -> int:
    """Bit of a mode's rule; 0 for ``off``."""
    return 0 if mode == "off" else 1 << RULES.index(mode if mode in RULES else "plain")


class Follower:
    """The rule of a stream: ``auto`` up to its first group, then that of the source with the most groups so far, the first by name among equals."""

    def __init__(self, names: list[str]):
        self.names, self.counts, self.rule = names, Counter(), rule_of("auto")

    def note(self, sources: set[int]) -> None:
        self.counts.update(self.names[i] for i in sources)
        top = min(self.counts, key=lambda s: (-self.counts[s], s)) if self.counts else None
        self.rule = rule_of(MODES.get(top, "off"))


def cutter(names: list[str] | None = None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for ``mapInPandas`` over (stream_id, line_no, value, bytes, goes, sources), sorted by stream and line: one row for each group.

    Without ``names`` a line goes on if any bit of ``goes`` is set; with them the
    stream's top source chooses the bit, from the line after the next group's first.
    Holds one group at a time, and a stream's counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun, stream, follower = False, None, None
        first, held, size, said = 0, [], 0, set()
        for pdf in batches:
            out = []
            for s, no, value, n_bytes, goes, sources in zip(pdf["stream_id"], pdf["line_no"], pdf["value"], pdf["bytes"], pdf["goes"], pdf["sources"]):
                same = begun and s == stream
                wanted = follower.rule if same and follower else ~0
                if same and goes & wanted and len(held) < GROUP_LINES and size < GROUP_BYTES:
                    held.append(value)
                    size += n_bytes
                    said.update(sources)
                    continue
                if begun:
                    out.append((stream, first, "\n".join(held), len(held)))
                    if same and follower:
                        follower.note(said)
                if not same:
                    begun, stream, follower = True, s, Follower(names) if names is not None else None
                first, held, size, said = no, [value], n_bytes, set(sources)
            yield pd.DataFrame(out, columns=["stream_id", "line_no", "value", "n_lines"])
        if begun:
            yield pd.DataFrame([(stream, first, "\n".join(held), len(held))], columns=["stream_id", "line_no", "value", "n_lines"])

    return run
