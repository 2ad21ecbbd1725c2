"""Which table answers a query. Routing changes results at unaligned ranges, so it is explicit."""

from __future__ import annotations

from datetime import timedelta

SHORT, LONG = timedelta(hours=6), timedelta(days=7)


def flow_tier(window: timedelta, table: str, by_address: bool = False) -> str:
    """raw, 5m or 1h: windows up to six hours read the five-minute tier; ports of one address only stand in the raw table."""
    if table == "ports" and by_address:
        return "raw"
    return "5m" if window <= SHORT else "1h"


def metric_tier(window: timedelta) -> str:
    return "base" if window <= SHORT else "5m" if window <= LONG else "1h"


def bucket_seconds(window: timedelta, choices: tuple[int, ...] = (5, 60, 300, 900, 3600, 14400, 86400), most: int = 90) -> int:
    """The smallest choice that makes `most` buckets or fewer; else the largest."""
    return next((c for c in choices if window.total_seconds() <= c * most), choices[-1])
