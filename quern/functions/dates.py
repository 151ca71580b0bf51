"""Partial dates in texts: YYYY, YYYY-MM or YYYY-MM-DD, - before years BC."""

from __future__ import annotations

import calendar
import re

#: Marks around a date that an expanded template gave.
ON, OFF = "\x01", "\x02"
MONTHS = {name.lower(): k for names in (calendar.month_name, calendar.month_abbr) for k, name in enumerate(names) if k} | {"sept": 9}
_PART = {
    "d": r"(\d{1,2})(?:st|nd|rd|th)?", "m": r"(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?", "y": r"(\d{3,4})", "e": r"(?:\s*(BCE?)\b)?",
}
# The ways of writing a date: their parts (day, month, year, era) and what stands between them.
_WAYS = [("dmye", (r"\s+", r",?\s+", "")), ("mdy", (r"\s+", r",?\s+")), ("my", (r",?\s+",)), ("ye", ("",))]
_PATTERN = re.compile(rf"{ON}(-?[\d-]+){OFF}|" + "|".join(r"\b" + "".join(_PART[p] + gap for p, gap in zip(parts, (*gaps, ""))) for parts, gaps in _WAYS), re.I)


def iso(year: int, month: int = 0, day: int = 0, bc: bool = False) -> str | None:
    """Month and day are held to their bounds only, not to the calendar; a day needs a month."""
    if year <= 0 or month not in range(13) or day not in range(32) or day and not month:
        return None
    return "-" * bc + "-".join([f"{year:04d}", *(f"{x:02d}" for x in (month, day) if x)])


def found(text: str) -> list[tuple[str, int, int]]:
    """(date, begin, end) of each date in order; those of expanded templates as they are; impossible ones left out."""
    out = []
    for m in _PATTERN.finditer(text):
        values = list(m.groups())
        date, at = values[0], 1
        for parts, _ in _WAYS if not date else ():
            own = dict(zip(parts, values[at : at + len(parts)]))
            at += len(parts)
            if own["y"]:
                date = iso(int(own["y"]), MONTHS[own["m"].lower()] if own.get("m") else 0, int(own.get("d") or 0), bool(own.get("e")))
        if date:
            out.append((date, m.start(), m.end()))
    return out


def scan(text: str) -> list[str]:
    """The dates alone."""
    return [d for d, _, _ in found(text)]


def parts_of(date: str) -> tuple[int, int, int, bool] | None:
    """Year, month, day and BC of a written date; null for anything else."""
    m = re.fullmatch(r"(-?)(\d{1,4})(?:-(\d\d))?(?:-(\d\d))?", date)
    if not m or m[3] and not 1 <= int(m[3]) <= 12 or m[4] and not 1 <= int(m[4]) <= 31:
        return None
    return int(m[2]), int(m[3] or 0), int(m[4] or 0), bool(m[1])


def said(date: str) -> str | None:
    """3 January 1920, January 1920, 1920, 300 BC."""
    got = parts_of(date)
    if not got:
        return None
    y, m, d, bc = got
    return " ".join([*([str(d)] if d else []), *([calendar.month_name[m]] if m else []), str(y)]) + " BC" * bc


def on_in(date: str) -> str:
    """on for whole dates, in for others."""
    return "on" if date.lstrip("-").count("-") == 2 else "in"
