"""Intervals as text."""

from __future__ import annotations

import datetime as dt


def format_months(months: int) -> str:
    """``N years M months``; a negative interval keeps its sign on both."""
    sign = -1 if months < 0 else 1
    years, rest = divmod(abs(months), 12)
    return f"{sign * years} years {sign * rest} months"


def format_interval(value: dt.timedelta) -> str:
    """ISO 8601 duration, such as PT26H3M4.5S."""
    micros = round(value.total_seconds() * 1_000_000)
    sign, micros = ("-" if micros < 0 else ""), abs(micros)
    seconds, part = divmod(micros, 1_000_000)
    hours, minutes, seconds = seconds // 3600, seconds // 60 % 60, seconds % 60
    tail = f"{seconds}.{part:06d}".rstrip("0") if part else f"{seconds}"
    out = (f"{sign}{hours}H" if hours else "") + (f"{sign}{minutes}M" if minutes else "") + (f"{sign}{tail}S" if seconds or part else "")
    return "PT" + (out or "0S")
