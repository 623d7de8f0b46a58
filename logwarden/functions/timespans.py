"""Durations of correlation rules."""

from __future__ import annotations

import re

#: Seconds of each unit.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}


def seconds(text: object) -> int | None:
    """Seconds of a text like 5m or 2 H; None for anything else. Units are read in either case, so M is minutes; there are no months."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z])\s*", str(text or "").lower(), re.ASCII)
    return int(m[1]) * UNITS[m[2]] if m and m[2] in UNITS else None
