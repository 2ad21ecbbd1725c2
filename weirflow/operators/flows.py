"""Search, tiers and top-k aggregation over flows, as DataFrame -> DataFrame functions.

Addresses are compared by their keys (src_ip_key, dst_ip_key): binaries, or numbers where a table has those.
"""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import bounds, in_network
from ..plans.router import flow_tier
from ..schema import PROTOCOLS, SEARCH_COLUMNS

MOST_WINDOW, MOST_ROWS, DEFAULT_ROWS = timedelta(days=7), 1000, 100
TALKERS = ("src_ip_key", "dst_ip_key", "protocol_number", "transport_protocol", "source_type")
PORTS = ("src_port", "dst_port", "protocol_number", "transport_protocol", "source_type")
WIDTHS = {"5m": "5 minutes", "1h": "1 hour"}
SPANS = {"5m": timedelta(minutes=5), "1h": timedelta(hours=1)}


class QueryError(ValueError):
    """A query that isn't allowed; args: code and message."""


@dataclass(frozen=True)
class Filters:
    """What a query asks for; None asks for nothing. Ranges of time are half-open, ranges of ports closed."""

    start: datetime
    end: datetime
    src_ip: str | None = None
    dst_ip: str | None = None
    src_cidr: str | None = None
    dst_cidr: str | None = None
    src_port: int | None = None
    dst_port: int | None = None
    src_ports: tuple[int, int] | None = None
    dst_ports: tuple[int, int] | None = None
    protocol_number: int | None = None
    transport_protocol: str | None = None
    source_type: str | None = None
    collector_id: str | None = None
    source_host: str | None = None
    application_protocol: str | None = None
    direction: str | None = None

    def check(self, limit: int = DEFAULT_ROWS) -> None:
        if not self.start < self.end:
            raise QueryError("invalid_parameter", "start must be before end")
        if self.end - self.start > MOST_WINDOW:
            raise QueryError("query_window_too_large", f"at most {MOST_WINDOW.days} days")
        if not 1 <= limit <= MOST_ROWS:
            raise QueryError("invalid_parameter", f"limit must be within 1..{MOST_ROWS}")
        for side in ("src", "dst"):
            if getattr(self, f"{side}_ip") and getattr(self, f"{side}_cidr"):
                raise QueryError("invalid_parameter", f"{side}_ip and {side}_cidr exclude each other")
            span = getattr(self, f"{side}_ports")
            if span and getattr(self, f"{side}_port") is not None:
                raise QueryError("invalid_parameter", f"{side}_port and {side}_ports exclude each other")
            if span and not 0 <= span[0] <= span[1] <= 65535:
                raise QueryError("invalid_parameter", f"{side}_ports must be a range")
        if self.protocol_number is not None and self.transport_protocol and PROTOCOLS.get(self.protocol_number, self.transport_protocol) != self.transport_protocol:
            raise QueryError("invalid_parameter", "protocol_number and transport_protocol differ")

    def where(self, df: DataFrame, time: str = "event_start_time") -> DataFrame:
        """df filtered; on a table partitioned by event_date, partitions are pruned too."""
        as_number = dict(df.dtypes).get("src_ip_key") == "bigint"
        key = lambda ip: F.lit(bounds(ip, as_number)[0])
        tests: list[Column] = [F.col(time) >= F.lit(self.start), F.col(time) < F.lit(self.end)]
        if dict(df.dtypes).get(time) == "timestamp_ntz":
            tests = [F.col(time) >= F.lit(str(self.start)).cast("timestamp_ntz"), F.col(time) < F.lit(str(self.end)).cast("timestamp_ntz")]
        if "event_date" in df.columns:
            tests.append(F.col("event_date").between(F.lit(self.start.date()), F.lit(self.end.date())))
        for side in ("src", "dst"):
            ip, cidr, port, span = (getattr(self, f"{side}_{x}") for x in ("ip", "cidr", "port", "ports"))
            tests += [F.col(f"{side}_ip_key") == key(str(ipaddress.ip_address(ip)))] if ip else []
            tests += [in_network(F.col(f"{side}_ip_key"), cidr, as_number)] if cidr else []
            tests += [F.col(f"{side}_port") == port] if port is not None else []
            tests += [F.col(f"{side}_port").between(*span)] if span else []
        for name in ("protocol_number", "transport_protocol", "source_type", "collector_id", "source_host", "application_protocol", "direction"):
            tests += [F.col(name) == getattr(self, name)] if getattr(self, name) is not None else []
        for test in tests:
            df = df.where(test)
        return df


def after(columns: list[tuple[str, bool]], cursor: tuple) -> Column:
    """Rows that come after the cursor in an order of (column, descending)."""
    found, equal = F.lit(False), F.lit(True)
    for (name, down), value in zip(columns, cursor, strict=True):
        c, v = F.col(name), value if isinstance(value, Column) else F.lit(value)
        found, equal = found | equal & (c < v if down else c > v), equal & (c == v)
    return found


def search(flows: DataFrame, filters: Filters, limit: int = DEFAULT_ROWS, cursor: tuple | None = None, attributes: bool = False) -> DataFrame:
    """Latest flows first, by event_start_time and id; cursor is (time, id) of the last row of the page before.

    One row more than `limit` tells that there is another page (see `page`).
    """
    filters.check(limit)
    found = filters.where(flows)
    if cursor:
        found = found.where(after([("event_start_time", True), ("id", True)], cursor))
    wanted = [c for c in (*SEARCH_COLUMNS, *(["attributes"] if attributes else [])) if c in flows.columns]
    return found.select(*wanted).orderBy(F.desc("event_start_time"), F.desc("id")).limit(limit + 1)


def sort_rows(rows: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """Rows of a page in order of event_start_time, bytes, packets, src_ip or dst_ip; missing counters count as 0. Addresses are in order of text."""
    if key not in ("event_start_time", "bytes", "packets", "src_ip", "dst_ip"):
        raise QueryError("invalid_parameter", f"rows can't be sorted by {key}")
    by = F.coalesce(F.col(key), F.lit(0)) if key in ("bytes", "packets") else F.col(key)
    return rows.orderBy(by.desc() if descending else by.asc())


def page(found: DataFrame, limit: int, keys: tuple[str, ...] = ("event_start_time", "id")) -> tuple[list, tuple | None]:
    """(rows, cursor of the next page or None) of a query that asked for limit + 1 rows."""
    rows = found.take(limit + 1)
    return rows[:limit], tuple(rows[limit - 1][k] for k in keys) if len(rows) > limit else None


def lookup(flows: DataFrame, flow_id: str, at: datetime | None = None) -> DataFrame:
    """The flow of an id; with its time, only that day's partition is read."""
    found = flows.where(F.col("id") == flow_id)
    if at is not None:
        found = found.where(F.col("event_start_time") == F.lit(at))
        found = found.where(F.col("event_date") == F.lit(at.date())) if "event_date" in flows.columns else found
    return found.limit(1)


def bucket(time: str, width: str) -> Column:
    return F.window(time, width)["start"]


def tier(flows: DataFrame, width: str, keys: tuple[str, ...] = TALKERS, time: str = "event_start_time") -> DataFrame:
    """Flows summed by bucket and keys: bucket, keys, total_bytes, total_packets, flow_count. Sums of nulls alone are null."""
    keys = tuple(k for k in keys if k in flows.columns)
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("bigint")
    return flows.groupBy(bucket(time, WIDTHS.get(width, width)).alias("bucket"), *keys).agg(total("bytes").alias("total_bytes"), total("packets").alias("total_packets"), F.count("*").alias("flow_count"))


@dataclass(frozen=True)
class Tables:
    """The raw flows and the tiers that stand; a tier that doesn't is computed from raw."""

    raw: DataFrame
    tiers: dict[tuple[str, str], DataFrame] | None = None

    def get(self, kind: str, which: str, filters: Filters | None = None) -> DataFrame:
        """A tier; one that doesn't stand reads no more of raw than the buckets that begin within the filters' times."""
        stored = (self.tiers or {}).get((kind, which))
        if stored is not None:
            return stored
        raw = self.raw
        if filters:
            raw = Filters(filters.start, filters.end + SPANS[which]).where(raw)
        return tier(raw, which, TALKERS if kind == "talkers" else PORTS)


@dataclass(frozen=True)
class TopK:
    """keys: what rows are grouped by; metric: bytes, packets or flows; which: auto, 5m, 1h or raw."""

    filters: Filters
    keys: tuple[str, ...]
    metric: str = "bytes"
    limit: int = 20
    which: str = "auto"
    cursor: tuple | None = None


def top(tables: Tables, q: TopK) -> DataFrame:
    """keys, value, flow_count in order of value, flow_count (both falling) and keys, limit + 1 rows.

    Tiers are filtered by the start of their buckets. On raw rows, flows without the metric don't count at all; on tiers
    only groups whose sum is null don't.
    """
    f = q.filters
    f.check(q.limit)
    kind = "ports" if any(k.endswith("port") for k in q.keys) else "talkers"
    which = flow_tier(f.end - f.start, kind, bool(f.src_ip or f.dst_ip)) if q.which == "auto" else q.which
    name = {"bytes": "bytes", "packets": "packets", "flows": None}[q.metric]
    if which == "raw":
        rows, value, count = f.where(tables.raw), F.col(name) if name else F.lit(1), F.lit(1)
    else:
        rows = f.where(tables.get(kind, which, f), "bucket")
        value, count = F.col(f"total_{name}") if name else F.col("flow_count"), F.col("flow_count")
    rows = rows.where(value.isNotNull()) if name else rows
    for k in q.keys:
        rows = rows.where(F.col(k).isNotNull()) if k.endswith("port") else rows
    total = lambda c: F.sum(c.cast("decimal(38,0)")).cast("bigint")
    found = rows.groupBy(*q.keys).agg(total(value).alias("value"), total(count).alias("flow_count"))
    if q.cursor:
        found = found.where(after([("value", True), ("flow_count", True), *[(k, False) for k in q.keys]], q.cursor))
    return found.orderBy(F.desc("value"), F.desc("flow_count"), *q.keys).limit(q.limit + 1)


def talkers(tables: Tables, filters: Filters, side: str = "src", **options) -> DataFrame:
    return top(tables, TopK(filters, (f"{side}_ip_key",), **options))


def ports(tables: Tables, filters: Filters, side: str = "dst", **options) -> DataFrame:
    return top(tables, TopK(filters, (f"{side}_port",), **options))


def protocols(tables: Tables, filters: Filters, **options) -> DataFrame:
    return top(tables, TopK(filters, ("protocol_number", "transport_protocol"), **options))


def next_page(q: TopK, cursor: tuple) -> TopK:
    return replace(q, cursor=cursor)


def first_wins(rows: DataFrame, keys: tuple[str, ...] = ("event_start_time", "idempotency_key"), order: tuple[str, ...] = ("ingested_at", "id")) -> DataFrame:
    """Of rows with equal keys the first in that order. min_by over a struct combines map-side, so a hot key stays small."""
    row = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(row).select("row.*")
