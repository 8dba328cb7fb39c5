"""Declarative connectors: where logs of an agent lie and how their fields map to events."""

from __future__ import annotations

import glob
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

FORMATS = ("jsonl", "markdown", "json-tree", "sqlite")
DETECTION = ("one-file-per-session", "delimiter", "key-pattern", "timestamp-gap")


@dataclass(frozen=True)
class Connector:
    """A validated connector.  Field names are dotted paths into a source's records."""

    name: str
    version: str
    paths: list[str]
    format: str
    exclude: list[str] = field(default_factory=list)
    detection: dict[str, Any] = field(default_factory=lambda: {"method": "one-file-per-session"})
    parser: dict[str, Any] = field(default_factory=dict)
    truncation_limit: int | None = None

    @property
    def static(self) -> dict[str, str]:
        return self.parser.get("static") or self.parser.get("static_fields") or {}

    @property
    def type_field(self) -> str | None:
        return self.parser.get("type") or self.parser.get("type_field")

    @property
    def role_map(self) -> dict[str, str]:
        return self.parser.get("role_map", {})

    @property
    def agent(self) -> str:
        return self.static.get("source_agent", self.name)


def validate(c: Connector) -> list[str]:
    """What is wrong with a connector, empty if nothing."""
    bad = []
    if not c.name.strip():
        bad.append("a connector needs a name")
    if not c.paths:
        bad.append("a connector needs at least one path")
    if c.format not in FORMATS:
        bad.append(f"format {c.format!r} is none of {', '.join(FORMATS)}")
    method = c.detection.get("method")
    if method not in DETECTION:
        bad.append(f"session detection {method!r} is none of {', '.join(DETECTION)}")
    if method == "delimiter" and not c.detection.get("delimiter_pattern"):
        bad.append("detection by delimiter needs delimiter_pattern")
    if c.format == "sqlite" and not c.parser.get("query"):
        bad.append("sqlite needs a query")
    if c.format == "markdown" and not any(c.parser.get(k) for k in ("user_prefix", "assistant_prefix", "tool_prefix")):
        bad.append("markdown needs a prefix")
    if c.format == "jsonl" and not c.parser.get("role"):
        bad.append("jsonl needs the role field")
    return bad


def load(path: str | Path) -> Connector:
    with open(path, "rb") as f:
        t = tomllib.load(f)
    head, source = t.get("plugin") or t.get("connector") or {}, t.get("source", {})
    c = Connector(
        name=head.get("name", ""), version=str(head.get("version", "")), paths=list(source.get("paths", [])), format=source.get("format", ""), exclude=list(source.get("exclude", [])),
        detection=source.get("session_detection") or {"method": "one-file-per-session"}, parser=t.get("parser", {}), truncation_limit=source.get("truncation_limit"),
    )
    if bad := validate(c):
        raise ValueError(f"{path}: " + "; ".join(bad))
    return c


def expanded(pattern: str) -> str:
    """A path pattern with home and variables filled in."""
    return os.path.expandvars(os.path.expanduser(pattern))


def discover(c: Connector) -> list[str]:
    """Files of a connector on the driver's own disk: its globs, without what the exclusions match (``ingest.listing`` does the same on any file system)."""
    out = {f for p in c.paths for f in glob.glob(expanded(p), recursive=True) if os.path.isfile(f)}
    gone = {f for p in c.exclude for f in glob.glob(expanded(p), recursive=True)}
    return sorted(out - gone)


def of_path(path: str, connectors: list[Connector]) -> Connector | None:
    """The first connector, in order of names, one of whose patterns a path fits and none of whose exclusions it does."""
    fits = lambda patterns: any(re.fullmatch(pattern_of(p), path) for p in patterns)
    return next((c for c in sorted(connectors, key=lambda c: c.name) if fits(c.paths) and not fits(c.exclude)), None)


def pattern_of(glob_: str) -> str:
    """A glob as a regular expression: ``**`` crosses folders, ``*`` and ``?`` do not, ``{a,b}`` are alternatives."""
    out, i, g, depth = "", 0, expanded(glob_), 0
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if g.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        depth += (c == "{") - (c == "}")
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "(?:" if c == "{" else ")" if c == "}" else "|" if c == "," and depth else re.escape(c)
        i += 1
    return out


# What in a path tells the agent, first that fits.
PATH_HINTS = [(".claude", "claude-code"), ("aider", "aider"), ("codex", "codex"), ("opencode", "opencode")]


def guess(path: str) -> str | None:
    """The connector that a single file is read with if none is named."""
    return next((name for part, name in PATH_HINTS if part in path), None)
