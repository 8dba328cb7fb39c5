"""Dates and durations as users write them, worked out when a query is built."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

_UNITS = {"h": 1 / 24, "hour": 1 / 24, "hours": 1 / 24, "d": 1, "day": 1, "days": 1, "w": 7, "week": 7, "weeks": 7, "mo": 30, "month": 30, "months": 30}


def duration(text: str) -> timedelta:
    """``30d``, ``12w``, ``6mo`` (30 days each), ``24h`` and the long names."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", text.lower())
    if not m or m[2] not in _UNITS:
        raise ValueError(f"no duration: {text!r}")
    return timedelta(days=int(m[1]) * _UNITS[m[2]])


def moment(text: str, as_of: datetime) -> datetime:
    """An instant: RFC 3339, a zone-less time or a date (UTC), or a duration before ``as_of``."""
    try:
        return as_of - duration(text.removesuffix(" ago"))
    except ValueError:
        pass
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def quarter(text: str) -> tuple[datetime, datetime]:
    """First and last second of ``2024-Q3``, ``2024Q3`` or ``Q3 2024``."""
    m = re.fullmatch(r"\s*(?:(\d{4})-?q([1-4])|q([1-4])[- ](\d{4}))\s*", text.lower())
    if not m:
        raise ValueError(f"no quarter: {text!r}")
    year, q = int(m[1] or m[4]), int(m[2] or m[3])
    start = datetime(year, 3 * q - 2, 1, tzinfo=timezone.utc)
    nxt = datetime(year + (q == 4), 1 if q == 4 else 3 * q + 1, 1, tzinfo=timezone.utc)
    return start, nxt - timedelta(seconds=1)
