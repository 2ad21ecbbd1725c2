"""JSON flow records: one JSON object with `records`, or one record a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flow import first_error, time_of, transport, unused
from ..functions.net import address
from ..schema import REST_FIELDS, REST_RECORD

MOST_RECORDS = 1000


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with a struct `rest` of the record on each; null if the line isn't one, or has a field that records don't have."""
    known = F.size(F.array_except(F.json_object_keys(column), F.lit(list(REST_FIELDS)))) == 0
    return lines.withColumn("rest", F.when(known, F.from_json(column, REST_RECORD, {"mode": "PERMISSIVE"})))


def explode(requests: DataFrame, column: str = "value") -> DataFrame:
    """One row per record of requests {"records": [...]}, in order (`record_index`); over-long requests, and those with fields that records don't have, give one row whose `rest` is null."""
    held = unused(requests, "_records")
    fields = F.flatten(F.transform(F.from_json(column, "records array<map<string,string>>")["records"], F.map_keys))
    body = F.when(F.size(F.array_except(fields, F.lit(list(REST_FIELDS)))) == 0, F.from_json(column, f"records array<struct<{REST_RECORD}>>")["records"])
    sized = requests.withColumn(held, body)
    many = F.coalesce(F.size(held), F.lit(0))
    listed = sized.where((many > 0) & (many <= MOST_RECORDS)).select("*", F.posexplode(held).alias("record_index", "rest"))
    bad = sized.where((many <= 0) | (many > MOST_RECORDS)).withColumn("record_index", F.lit(0)).withColumn("rest", F.lit(None).cast(listed.schema["rest"].dataType))
    return listed.drop(held).unionByName(bad.drop(held))


def error(rest: str = "rest") -> Column:
    """The code of the first rule that a record breaks, or null."""
    c = lambda name: F.col(f"{rest}.{name}")
    start, end = time_of(c("event_start_time")), time_of(c("event_end_time"))
    has_end = F.coalesce(c("event_end_time") != "", F.lit(False))
    name = transport(c("transport_protocol"))
    ports = name.isin("tcp", "udp")
    bad_port = lambda p: ports & (p.isNull() | ~p.between(0, 65535))
    return first_error(
        (F.col(rest).isNull(), "invalid_record"),
        (start.isNull(), "invalid_event_start_time"),
        (has_end & (end.isNull() | (end < start)), "invalid_event_end_time"),
        (address(c("src_ip"))["key"].isNull(), "invalid_src_ip"),
        (address(c("dst_ip"))["key"].isNull(), "invalid_dst_ip"),
        (~F.coalesce(c("protocol_number"), F.lit(0)).between(0, 255), "invalid_protocol_number"),
        (name.isNull() | (name == "unknown"), "invalid_transport_protocol"),
        (bad_port(c("src_port")), "invalid_src_port"),
        (bad_port(c("dst_port")), "invalid_dst_port"),
        ((c("bytes") < 0) | (c("packets") < 0) | (c("bytes") > 2**63 - 1) | (c("packets") > 2**63 - 1), "invalid_counter"),
    )
