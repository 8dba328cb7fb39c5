"""Reports as Markdown, HTML and JSON, sessions to read, summaries, and rule blocks in project files.  Inputs are small aggregates or one session."""

from __future__ import annotations

import html
import json
from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame

BEGIN, END = "<!-- begin generated rules -->", "<!-- end generated rules -->"


def markdown_table(df: DataFrame, title: str, most: int = 50) -> str:
    """The first rows of an aggregate as a Markdown section."""
    rows = df.limit(most).collect()
    text = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([f"## {title}", "", *(head + ["| " + " | ".join(map(text, r)) + " |" for r in rows] if rows else ["Nothing in this period."]), ""])


def to_json(parts: dict[str, DataFrame], most: int = 1000) -> str:
    return json.dumps({k: [r.asDict(recursive=True) for r in df.limit(most).collect()] for k, df in parts.items()}, default=str, sort_keys=True)


def insights(agents: list[dict], months: list[dict], least: int = 3) -> list[str]:
    """Sentences about the best and the busiest agent and about growth; agents with few sessions are no evidence."""
    known = [a for a in agents if a["total_sessions"] >= least]
    out = []
    if known:
        best = max(known, key=lambda a: (a["success_rate"], a["agent"]))
        busy = max(known, key=lambda a: (a["total_sessions"], a["agent"]))
        out.append(f"{best['agent']} ends well most often ({best['success_rate']:.0f} % of {best['total_sessions']} sessions).")
        out.append(f"{busy['agent']} is used most ({busy['total_sessions']} sessions).")
    if len(months) > 1 and months[0]["sessions"]:
        out.append(f"Sessions changed by {100 * (months[-1]['sessions'] - months[0]['sessions']) / months[0]['sessions']:+.0f} % from {months[0]['month']} to {months[-1]['month']}.")
    return out


def put_block(existing: str, block: str) -> str:
    """The text with its generated block replaced, or the block put in front where there is none."""
    new = f"{BEGIN}\n{block.strip()}\n{END}"
    if BEGIN in existing and END in existing:
        a, b = existing.index(BEGIN), existing.index(END) + len(END)
        return existing[:a] + new + existing[b:]
    return f"{new}\n\n{existing}" if existing else new + "\n"


def to_html(parts: dict[str, DataFrame], title: str, most: int = 1000) -> str:
    """The first rows of aggregates as a page of tables."""
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else f'{v:.2f}' if isinstance(v, float) else str(v))}</{tag}>"
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in parts.items():
        rows = df.limit(most).collect()
        out.append(f"<h2>{html.escape(name)}</h2>")
        out.append("<table><tr>" + "".join(cell("th", c) for c in df.columns) + "</tr>" + "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows) + "</table>" if rows else "<p>Nothing in this period.</p>")
    return "\n".join(out)


def summary_markdown(facts: dict[str, Any], summary: str, solution: str | None = None) -> str:
    """One session in a few lines: what was asked, how it ended, what was done."""
    head = [f"# {facts['session_id']}", "", summary, "", f"- Project: {facts.get('project') or '-'}", f"- Outcome: {facts.get('outcome') or 'unknown'}", f"- Turns: {facts.get('turns') or 0}"]
    if facts.get("started"):
        head.append(f"- Took: {duration(facts['started'], facts.get('ended'))}")
    return "\n".join([*head, *(["", "## Solution", "", "```", solution, "```"] if solution else []), ""])


#: Who speaks, for readers.
SPEAKERS = {"user": "User", "assistant": "Assistant", "tool_call": "Tool", "tool_result": "Result", "system": "System"}


def session_markdown(session: str, events: list[dict[str, Any]]) -> str:
    """A session to read.  ``events``: role, content, tool, ts, in order."""
    out = [f"# {session}", ""]
    for e in events:
        who = SPEAKERS.get(e["role"], capitalized(e["role"])) + (f" ({e['tool']})" if e.get("tool") else "")
        text = e.get("content") or ""
        out += [f"## {who}" + (f" at {e['ts']:%Y-%m-%d %H:%M:%S}" if e.get("ts") else ""), "", f"````\n{text}\n````" if e["role"] in ("tool_call", "tool_result") and text else text, ""]
    return "\n".join(out)


def session_html(session: str, events: list[dict[str, Any]]) -> str:
    body = "".join(f"<section class={e['role']}><h2>{html.escape(SPEAKERS.get(e['role'], e['role']))}</h2><pre>{html.escape(e.get('content') or '')}</pre></section>" for e in events)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(session)}</title><h1>{html.escape(session)}</h1>{body}"


#: Headings of the kinds of rules.
HEADINGS = {"correction": "Corrections", "convention": "Conventions", "warning": "Known pitfalls", "context": "Context"}


def rules_text(rules: list[dict[str, Any]], form: str = "markdown") -> str:
    """Rules (category, rule, in their order) as ``markdown`` under headings, as a plain ``list``, or ``inline`` in one line."""
    if form == "inline":
        return "; ".join(r["rule"] for r in rules)
    if form == "list":
        return "\n".join(f"- {r['rule']}" for r in rules)
    if form != "markdown":
        raise ValueError(f"{form!r} is none of markdown, list, inline")
    out = []
    for kind, heading in HEADINGS.items():
        of = [r["rule"] for r in rules if r["category"] == kind]
        out += [f"## {heading}", "", *[f"- {x}" for x in of], ""] if of else []
    return "\n".join(out)


# words and numbers for people ------------------------------------------------------------------------


def wrapped(text: str, width: int) -> str:
    """Words in lines shorter than a width (longer words stand alone), lengths in bytes."""
    lines: list[list[str]] = []
    length = 0
    for w in text.split():
        n = len(w.encode())
        if lines and length + n < width:
            lines[-1].append(w)
            length += n + 1
        else:
            lines.append([w])
            length = n
    return "\n".join(" ".join(x) for x in lines)


def listed(items: list[str]) -> str:
    """A list in words: up to five in full, of more the first three."""
    if not items:
        return "(none)"
    if len(items) <= 2:
        return " and ".join(items)
    return f"{', '.join(items[:-1])}, and {items[-1]}" if len(items) <= 5 else f"{', '.join(items[:3])}, ... ({len(items)} total)"


def size(n: int) -> str:
    """Bytes in the largest unit that gives one or more."""
    for unit, power in (("GB", 3), ("MB", 2), ("KB", 1)):
        if n >= 1024**power:
            return f"{n / 1024**power:.1f} {unit}"
    return f"{n} B"


def duration(start: datetime, end: datetime | None = None) -> str:
    """Days, hours and minutes between two times; a session that goes on lasts until now."""
    minutes = int(((end or datetime.now(timezone.utc).replace(tzinfo=start.tzinfo)) - start).total_seconds()) // 60
    parts = [(minutes // 1440, "d"), (minutes // 60 % 24, "h"), (minutes % 60, "m")]
    return " ".join(f"{n}{u}" for n, u in parts if n > 0) or "<1m"


def ago(then: datetime, now: datetime) -> str:
    """How long ago, in the largest whole unit."""
    gone = now - then
    for unit, each in (("d", timedelta(days=1)), ("h", timedelta(hours=1)), ("m", timedelta(minutes=1))):
        if gone >= each:
            return f"{gone // each}{unit} ago"
    return "just now"


def minutes(n: float | None) -> str:
    """A forecast in minutes: hours from sixty on, nothing to forecast is a dash."""
    return "-" if n is None else f"{int(n)}m" if n < 60 else f"{int(n) // 60}h {int(n) % 60}m"


def bar(value: float, most: float, width: int = 20) -> str:
    """A bar of full and empty blocks."""
    full = min(round(value / most * width) if most > 0 else 0, width)
    return "\u2588" * full + "\u2591" * (width - full)


def capitalized(s: str) -> str:
    return s[:1].upper() + s[1:]


def reset_time(raw: str | None) -> datetime | None:
    """The instant at which a limit ends (RFC 3339), null if it is none."""
    try:
        got = datetime.fromisoformat(raw or "")
    except ValueError:
        return None
    return got.astimezone(timezone.utc) if got.tzinfo else None
