"""What a raw event's envelope must fulfil, as a column: the first rule that it breaks, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RAW_VERSION, SOURCE_TYPES
from ..sources.netflow9 import IPV4, IPV6
from .flow import first_error, is_uuid7
from .net import is_ipv6

# The payload that goes with each source type; Suricata has none in this version.
PAYLOADS = {"netflow_v5": "netflow_v5", "netflow_v9": "netflow_v9", "zeek_conn_json": "zeek_conn", "rest_json": "rest_flow", "syslog_cef": "syslog", "syslog_leef": "syslog"}
#: Columns of an envelope that `error` reads; payload names which one is set.
COLUMNS = "event_id string, schema_version string, collector_id string, source_type string, source_host string, received_at timestamp, partition_key string, payload string"
#: A decoded field of a NetFlow v9 record: one of the three values is set.
FIELD = "field_id bigint, field_length bigint, name string, unsigned_value decimal(20,0), string_value string, bytes_value binary"


def partition_key() -> Column:
    return F.concat(F.coalesce("collector_id", F.lit("")), F.lit(":"), F.coalesce("source_host", F.lit("")))


def bad_field(f: Column) -> Column:
    """Whether a decoded field breaks a rule of its id, its length or its value."""
    n, text = f["field_length"], f["string_value"]
    kinds = f["unsigned_value"].isNotNull().cast("int") + text.isNotNull().cast("int") + f["bytes_value"].isNotNull().cast("int")
    quad = text.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$")
    wrong_text = F.when(f["field_id"].isin(*IPV4), ~quad | (n != 4)).when(f["field_id"].isin(*IPV6), ~is_ipv6(text) | (n != 16)).otherwise(F.octet_length(text) > n)
    most = F.pow(F.lit(2.0), F.lit(8) * n)
    bad = (
        ~f["field_id"].between(1, 65535) | ~n.between(1, 65535) | (f["name"].isNotNull() & (F.trim(f["name"]) == "")) | (kinds != 1)
        | F.coalesce(f["unsigned_value"].isNotNull() & ((n > 8) | (n < 8) & (f["unsigned_value"] >= most)), F.lit(False))
        | F.coalesce(wrong_text, F.lit(False)) | F.coalesce(F.octet_length(f["bytes_value"]) != n, F.lit(False))
    )
    return f.isNull() | F.coalesce(bad, F.lit(True))


def error(decoded_fields: Column | None = None) -> Column:
    """The first broken rule of an envelope with COLUMNS; decoded_fields: array<struct<FIELD>> of NetFlow v9 payloads."""
    c = F.col
    blank = lambda name: F.coalesce(F.trim(c(name)) == "", F.lit(True))
    wanted = F.coalesce(*[F.when(c("source_type") == kind, F.lit(name)) for kind, name in PAYLOADS.items()])
    fields = F.lit(False) if decoded_fields is None else (c("payload") == "netflow_v9") & F.coalesce(F.exists(decoded_fields, bad_field), F.lit(False))
    return first_error(
        (~is_uuid7(c("event_id")), "event_id"),
        (F.coalesce(c("schema_version") != RAW_VERSION, F.lit(True)), "schema_version"),
        (blank("collector_id"), "collector_id"),
        (blank("source_type"), "source_type"),
        (blank("source_host"), "source_host"),
        (~c("source_type").isin(*SOURCE_TYPES), "unknown_source_type"),
        (c("received_at").isNull(), "received_at"),
        (F.coalesce(c("partition_key"), F.lit("")) != partition_key(), "partition_key"),
        (c("payload").isNull(), "payload_missing"),
        (c("source_type") == "suricata_eve_json", "payload_undefined"),
        (c("payload") != wanted, "payload_mismatch"),
        (fields, "decoded_fields"),
    )
