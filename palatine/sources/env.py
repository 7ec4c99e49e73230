"""Settings from a local file of KEY=VALUE lines; the real environment wins."""

from __future__ import annotations

import os
from pathlib import Path


def parse_settings(text: str) -> dict[str, str]:
    """Lines ``[export ]KEY=VALUE``; blank lines, comments and lines without a key are skipped, matching quotes are taken off."""
    out = {}
    for line in text.splitlines():
        key, sep, value = line.strip().removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if not sep or not key or key.startswith("#"):
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[key] = value
    return out


def load_settings(*folders: str, name: str = ".env.local") -> dict[str, str]:
    """Set what the first file found in ``folders`` gives and the environment lacks; returns what was set."""
    found = next((p for f in folders if (p := Path(f, name)).is_file()), None)
    new = {k: v for k, v in parse_settings(found.read_text(encoding="utf-8")).items() if k not in os.environ} if found else {}
    os.environ.update(new)
    return new


def resolve(*candidates: str | None, default: str | None = None) -> str:
    """The first non-empty of the candidates (command line, then environment), else the default; an error without any."""
    value = next((c for c in candidates if c), default)
    if not value:
        raise LookupError("a required setting is missing")
    return value
