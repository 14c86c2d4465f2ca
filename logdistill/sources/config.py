"""Options from a small YAML file: top-level keys, lists, and lists of mappings."""

from __future__ import annotations

import os
import re

from logdistill.operators import detection
from logdistill.operators.kernel import Options

LISTS = ("sources", "diagnostics", "ignores", "sanitizers", "internals")


class InvalidConfig(ValueError):
    """A rule that isn't a regular expression."""


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if re.fullmatch(r"-?\d+(\.\d+)?", text):
        return float(text) if "." in text else int(text)
    return {"true": True, "false": False, "null": None, "~": None}.get(text, text)


def parse(text: str) -> dict:
    """The file's lists. What follows a # is a comment, in quotes too; entries of other types are left out."""
    found: dict = {}
    key = item = inner = None
    for raw in text.splitlines():
        line = re.sub(r"#.*$", "", raw).rstrip()
        if not line.strip():
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        if indent == 0 and ":" in body:
            key, _, rest = body.partition(":")
            found[key] = _scalar(rest) if rest.strip() else []
            item = inner = None
        elif indent == 2 and body.startswith("- ") and isinstance(found.get(key), list):
            body = body[2:].strip()
            m = re.match(r"^(\w+):\s*(.*)$", body)
            item = {m[1]: _scalar(m[2])} if m else None
            inner = m[1] if m and not m[2] else None
            if inner:
                item[inner] = []
            found[key].append(item if m else _scalar(body))
        elif indent >= 4 and item is not None:
            if body.startswith("- ") and inner:
                item[inner].append(_scalar(body[2:]))
            elif m := re.match(r"^(\w+):\s*(.*)$", body):
                inner = None if m[2] else m[1]
                item[m[1]] = _scalar(m[2]) if m[2] else []
    return clean(found)


def clean(found: dict) -> dict:
    def strings(x) -> list[str]:
        return [s for s in x if isinstance(s, str)] if isinstance(x, list) else []

    sources = {
        s["name"]: strings(s.get("markers")) for s in found.get("sources") or [] if isinstance(s, dict) and isinstance(s.get("name"), str) and strings(s.get("markers"))
    }
    rules = [
        (r["pattern"], str(r.get("replacement", "")), str(r.get("flags", "gu")))
        for r in found.get("sanitizers") or []
        if isinstance(r, dict) and isinstance(r.get("pattern"), str)
    ]
    out = {"sources": sources, "sanitizers": rules} | {k: strings(found.get(k)) for k in ("diagnostics", "ignores", "internals")}
    for p in [*out["diagnostics"], *out["ignores"], *out["internals"], *(r[0] for r in rules)]:
        try:
            re.compile(re.sub(r"\\p\{\w+\}", "x", p))
        except re.error as e:
            raise InvalidConfig(f"{p}: {e}") from e
    return out


def load(path: str | None = None) -> dict:
    """The file's lists; a missing file is an empty one. Without a path: .logdistill.yml in the working folder."""
    path = path or os.path.join(os.getcwd(), ".logdistill.yml")
    if not os.path.exists(path):
        return clean({})
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def options(config: dict, inline: Options | None = None) -> Options:
    """Rules and sources of the file before those given inline; markers of one source are joined."""
    o = inline or Options()
    sources = detection.merged(config["sources"], o.sources)
    return Options(**(o.__dict__ | {"sources": sources} | {k: [*config[k], *getattr(o, k)] for k in ("diagnostics", "ignores", "sanitizers", "internals")}))
