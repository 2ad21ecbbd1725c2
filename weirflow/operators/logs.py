"""Log search and merging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 1000


def search(logs: DataFrame, start: datetime | None = None, end: datetime | None = None, level: str | None = None, text: str | None = None, limit: int = 100, ties: tuple[str, ...] = ("message",)) -> DataFrame:
    """Latest lines first. text is looked for in message and attributes, whatever the case; % and _ in it are wildcards."""
    ntz = dict(logs.dtypes)["timestamp"] == "timestamp_ntz"
    at = (lambda t: F.lit(str(t)).cast("timestamp_ntz")) if ntz else F.lit
    found = logs
    found = found.where(F.col("timestamp") >= at(start)) if start else found
    found = found.where(F.col("timestamp") < at(end)) if end else found
    found = found.where(F.col("level") == level) if level else found
    if text:
        found = found.where(F.col("message").ilike(f"%{text}%") | F.col("attributes").ilike(f"%{text}%"))
    return found.orderBy(F.desc("timestamp"), *ties).limit(max(1, min(limit, MOST_ROWS)))


def merge(*parts: DataFrame) -> DataFrame:
    """All lines of several results, each once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates()
