"""Small sources read on the driver: project registry, version-control log, cached usage."""

from __future__ import annotations

import json
import re
import subprocess
import time
import tomllib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEX_COLOUR = re.compile(r"^#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6})$")


class RegistryError(ValueError):
    """A registry that cannot be used."""


def _yaml() -> Any:
    try:
        import yaml
    except ImportError as e:  # the reader is optional
        raise RuntimeError("a registry needs a YAML reader") from e
    return yaml


def registry(path: str | Path) -> tuple[list[dict[str, Any]], list[str]]:
    """Projects and warnings of a registry in its first form (name, path) or its second (projects with workspaces).

    An error: a name twice, path and workspaces both or neither, an empty path
    or role, a colour that is none.  A role twice in a project is a warning, a
    project without name is left out with one.
    """
    data = _yaml().safe_load(Path(path).read_text()) or {}
    warnings: list[str] = []
    out: list[dict[str, Any]] = []
    items = data.get("projects") if isinstance(data, dict) else data
    for p in items or ([data] if isinstance(data, dict) and data.get("name") else []):
        name = p.get("name")
        if not name:
            warnings.append("a project without name was left out")
            continue
        if any(o["name"] == name for o in out):
            raise RegistryError(f"{name}: two projects of this name")
        if bool(p.get("path")) == bool(p.get("workspaces")):
            raise RegistryError(f"{name}: needs a path or workspaces, and not both")
        spaces = p.get("workspaces") or [{"path": p["path"]}]
        spaces = [{"path": s, "role": "primary"} if isinstance(s, str) else {"path": s.get("path"), "role": s.get("role", "primary")} for s in spaces]
        for s in spaces:
            if not str(s["path"] or "").strip() or not str(s["role"] or "").strip():
                raise RegistryError(f"{name}: a workspace has an empty path or role")
        roles = [s["role"] for s in spaces]
        warnings += [f"{name}: role {r!r} is there twice" for r in dict.fromkeys(roles) if roles.count(r) > 1]
        if p.get("color") and not HEX_COLOUR.match(str(p["color"])):
            raise RegistryError(f"{name}: {p['color']!r} is no colour")
        out.append({"name": name, "label": p.get("label") or name, "color": p.get("color"), "workspaces": spaces})
    return out, warnings


def save_registry(projects: list[dict[str, Any]], path: str | Path) -> None:
    """Write projects in the second form; folders are made, and the file appears whole."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    new = p.with_name(p.name + ".new")
    new.write_text(_yaml().safe_dump({"version": "0.2", "projects": projects}, sort_keys=False, allow_unicode=True))
    new.replace(p)


def migrate_registry(path: str | Path) -> list[str]:
    """Bring a registry of the first form into the second, in place; its warnings."""
    projects, warnings = registry(path)
    save_registry(projects, path)
    return warnings


def registry_table(spark: SparkSession, projects: list[dict[str, Any]]) -> DataFrame:
    """name, label, color, workspaces (path, role)."""
    rows = [(p["name"], p["label"], p["color"], [(w["path"], w["role"]) for w in p["workspaces"]]) for p in projects]
    return spark.createDataFrame(rows, "name string, label string, color string, workspaces array<struct<path: string, role: string>>")


def config(path: str | Path, defaults: dict[str, Any] | None = None) -> dict[str, Any]:
    """A configuration (TOML) over its defaults, table by table; the defaults alone where there is no file."""
    p = Path(path)
    said = tomllib.loads(p.read_text()) if p.exists() else {}

    def over(a: dict[str, Any], b: dict[str, Any]) -> dict[str, Any]:
        return {k: over(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b[k] if k in b else a[k] for k in {**a, **b}}

    return over(defaults or {}, said)


def plan_of(folder: str | Path) -> tuple[str, str]:
    """Plan and tier that an account's credentials name, "unknown" where they do not; nothing else of the file is kept."""
    p = Path(folder) / ".credentials.json"
    try:
        said = json.loads(p.read_text()).get("claudeAiOauth") or {}
    except FileNotFoundError:
        said = {}
    return said.get("subscriptionType") or "unknown", said.get("rateLimitTier") or "unknown"


def account_paths(folder: str | Path, cache: str | Path) -> dict[str, str]:
    """Id, projects folder and usage cache of an account, from its folder's name."""
    f = Path(folder)
    usual = f.name == ".claude"
    return {"account": "claude-default" if usual else f.name or "unknown", "projects": str(f / "projects"), "usage": str(Path(cache) / "claude-usage" / ("usage.json" if usual else f"{f.name or 'unknown'}-usage.json"))}


def blame_spec(spec: str) -> tuple[str, int | None]:
    """``file`` or ``file:line``."""
    file, colon, line = spec.rpartition(":")
    return (file, int(line)) if colon and line.isascii() and line.isdigit() else (spec, None)


def commits(spark: SparkSession, repo: str, since: str | None = None) -> DataFrame:
    """hash, short, author, ts, subject of a repository; the subject comes last, so that it may hold the separator."""
    cmd = ["git", "-C", repo, "log", "--pretty=format:%H|%h|%aI|%an|%s", *([f"--since={since}"] if since else [])]
    done = subprocess.run(cmd, capture_output=True, text=True, check=False)
    rows = [tuple(x.split("|", 4)) for x in done.stdout.splitlines() if x.count("|") >= 4]
    return spark.createDataFrame(rows, "hash string, short string, at string, author string, subject string").selectExpr("hash", "short", "author", "cast(try_to_timestamp(at) as timestamp_ntz) as ts", "subject")


def commit_folder(folder: str, message: str) -> str | None:
    """Keep a folder's present state in version control (set up where there is none); the commit, or None if nothing changed."""
    run = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=False)
    if run("rev-parse", "--git-dir").returncode:
        run("init", "-q")
    run("add", "-A")
    if run("diff", "--cached", "--quiet").returncode == 0:
        return None
    done = run("-c", "user.name=quern", "-c", "user.email=quern@localhost", "commit", "-qm", message)
    return run("rev-parse", "HEAD").stdout.strip() if done.returncode == 0 else None


def blame(repo: str, file: str, line: int) -> str | None:
    done = subprocess.run(["git", "-C", repo, "blame", "--porcelain", "-L", f"{line},{line}", "--", file], capture_output=True, text=True, check=False)
    return done.stdout.split(" ", 1)[0] or None if done.returncode == 0 else None


def cached_usage(path: str | Path, max_age_seconds: float) -> dict[str, Any] | None:
    """The usage cache if it is there, fresh and readable."""
    p = Path(path)
    try:
        if time.time() - p.stat().st_mtime > max_age_seconds:
            return None
        return json.loads(p.read_text())
    except (OSError, ValueError):
        return None


def blamed_sessions(spark: SparkSession, repo: str, spec: str, index: DataFrame) -> DataFrame:
    """The sessions that a line of a file goes back to.  ``index``: hash (full or short), session_id; an unknown line gives no rows."""
    file, line = blame_spec(spec)
    commit = blame(repo, file, line or 1) or ""
    return index.where((index["hash"] != "") & F.lit(commit).startswith(index["hash"])).select("session_id").distinct()
