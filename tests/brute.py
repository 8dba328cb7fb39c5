"""Plain brute-force versions that the operators are tested against."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
ABBR = {"UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "PST": -480, "PDT": -420, "JST": 540}
FORMATS = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d %H:%M:%S", "%Y%m%dT%H%M%S", "%d.%m.%Y %H:%M:%S", "%b %d, %Y %I:%M:%S %p", "%m/%d/%Y %I:%M:%S %p", "%a, %d %b %Y %H:%M:%S"]


def instants_of_wall(wall: datetime, zone: str) -> set[datetime]:
    """Every instant at which the zone's clock showed the time, by trying all offsets in quarter hours."""
    z = ZoneInfo(zone)
    out = set()
    for q in range(-56, 57):
        u = (wall - timedelta(minutes=15 * q)).replace(tzinfo=timezone.utc)
        if u.astimezone(z).replace(tzinfo=None) == wall:
            out.add(u)
    return out


def utc_ms(raw: str | None, zone: str | None) -> int | None:
    if raw is None:
        return None
    s = raw.strip()
    if re.fullmatch(r"\d{10}|\d{13}|\d{16}|\d{19}", s):
        return int(s) * 1000 if len(s) == 10 else int(s) // 10 ** (len(s) - 13)
    s = re.sub(r"\[.*\]$", "", s)
    off = None
    if m := re.search(r"\s*([A-Za-z]{3,4})$", s):
        if m[1].upper() in ABBR:
            off, s = ABBR[m[1].upper()], s[: m.start()]
    if off is None and (m := re.search(r"(?<=\d)\s*[zZ]$", s)):
        off, s = 0, s[: m.start()]
    if off is None and (m := re.search(r"(?<=:\d\d)\s*([+-])(\d\d):?(\d\d)?$", s) or re.search(r"(?<=[.,]\d{3})([+-])(\d\d):?(\d\d)?$", s)):
        off, s = (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3] or 0)), s[: m.start()]
    ms = 0
    if m := re.search(r"[.,](\d{3,9})$", s):
        ms, s = int(m[1][:3]), s[: m.start()]
    for f in FORMATS:
        try:
            wall = datetime.strptime(s, f)
        except ValueError:
            continue
        if off is not None:
            u = {wall.replace(tzinfo=timezone.utc) - timedelta(minutes=off)}
        else:
            u = instants_of_wall(wall, zone) if zone else set()
        return (u.pop() - EPOCH) // timedelta(milliseconds=1) + ms if len(u) == 1 else None
    return None
