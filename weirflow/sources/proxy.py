"""Batches of a forwarding proxy: NetFlow datagrams in base64, each with the exporter's address and the time the proxy got it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flow import first_error, time_of, unused
from ..functions.net import address, unmapped
from .netflow5 import route

#: A proxy's time counts if it is this close to the receipt by the backend.
MOST_SKEW, MOST_AGE = timedelta(minutes=5), timedelta(hours=24)
_BASE64 = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def explode(requests: DataFrame, column: str = "value") -> DataFrame:
    """One row per record of requests {"records": [{packet_data, source_ip, received_at}]}, with record_index; the record's fields replace columns of their names."""
    held = unused(requests, "_record")
    records = F.from_json(column, "records array<struct<packet_data string, source_ip string, received_at string>>")["records"]
    listed = requests.select("*", F.posexplode(records).alias("record_index", held))
    return listed.withColumns({name: F.col(f"{held}.{name}") for name in ("packet_data", "source_ip", "received_at")}).drop(held)


def timestamp_reason(text: Column, now: Column) -> Column:
    """Why a proxy's time doesn't count: invalid, future or old; null if it does, or there is none."""
    at = time_of(text)
    return first_error(
        (text.isNotNull() & at.isNull(), "invalid"),
        (at > now + F.lit(MOST_SKEW), "future"),
        (at < now - F.lit(MOST_AGE), "old"),
    )


def accept(records: DataFrame, now: Column) -> DataFrame:
    """records with packet, kind, source_ip (canonical), proxy_received_at, timestamp_reason, status (accepted or rejected) and error_code.

    A time that doesn't count is dropped, not its record. The status is each record's own: one bad record spoils no other.
    """
    text = F.regexp_replace("packet_data", r"[\r\n]", "")
    sound = F.coalesce(text.rlike(_BASE64), F.lit(False))
    held = unused(records, "_from")
    rows = records.withColumn("packet", F.when(sound, F.unbase64(text))).withColumn(held, address("source_ip"))
    rows = rows.withColumn(held, unmapped(F.col(held)))
    rows = route(rows)
    reason = timestamp_reason(F.col("received_at"), now)
    error = first_error((~sound, "invalid_base64"), (F.col(held)["key"].isNull(), "invalid_source_ip"), (F.col("kind") == "unknown", "unsupported_version"))
    return rows.withColumns({
        "source_ip": F.col(held)["text"], "timestamp_reason": reason, "proxy_received_at": F.when(reason.isNull(), time_of(F.col("received_at"))),
        "error_code": error, "status": F.when(error.isNull(), "accepted").otherwise("rejected"),
    }).drop(held)
