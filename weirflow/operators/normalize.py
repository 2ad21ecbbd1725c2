"""From decoded records of the four sources to flows of one schema. Errors are data: `split` parts sound flows from bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flow as fn
from ..functions.net import address, direction, version
from ..schema import DIRECTIONS, FLOW_COLUMNS, FLOW_VERSION, LOCAL_NETWORKS, SOURCE_TYPES, TRANSPORTS



def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _attributes(**values: Column) -> Column:
    """A map of those values that aren't null, as text."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def _finish(df: DataFrame, networks: tuple[str, ...], keys: tuple[Column, Column] | None = None, nanos: tuple[Column, Column] = (None, None)) -> DataFrame:
    """df has the raw columns set by a source's normalizer; what all sources share is added here. keys: of src_raw and dst_raw, if the source has them."""
    if keys:
        src, dst = (F.struct(F.col(raw).alias("text"), key.alias("key")) for raw, key in zip(("src_raw", "dst_raw"), keys, strict=True))
    else:
        src, dst = address("src_raw"), address("dst_raw")
    df = df.withColumn("_src", src).withColumn("_dst", dst).withColumn("_from", address("source_ip"))
    df = df.withColumns({
        "src_ip": F.col("_src.text"), "dst_ip": F.col("_dst.text"), "src_ip_key": F.col("_src.key"), "dst_ip_key": F.col("_dst.key"), "source_ip": F.col("_from.text"),
        "schema_version": F.lit(FLOW_VERSION), "raw_event_id": F.col("event_id"), "ingested_at": F.col("received_at"), "normalized_at": F.col("received_at"),
    })
    df = df.withColumn("direction", direction(F.col("src_ip_key"), F.col("dst_ip_key"), networks)).withColumn("ip_version", version(F.col("src_ip_key")))
    partial = F.col("reasons")
    df = df.withColumns({
        "normalization_status": F.when(F.size(partial) > 0, "partial").otherwise("ok"),
        "normalization_error": F.element_at(F.when(F.size(partial) > 0, partial), -1),  # the last reason counts
        "idempotency_key": fn.idempotency_key(F.coalesce(F.col("native"), fn.tuple_identity()), *nanos),
        "attributes": fn.mask_json("attributes"),
    })
    df = df.withColumn("id", fn.uuid7(F.col("ingested_at"), F.concat_ws("|", "idempotency_key", "raw_event_id")))
    return df.withColumn("error", F.coalesce(F.col("error"), invalid())).select(*FLOW_COLUMNS, "error")


def invalid() -> Column:
    """The first rule of the flow model that a flow breaks, or null."""
    c = F.col
    blank = lambda name: F.coalesce(F.trim(c(name)) == "", F.lit(True))
    return fn.first_error(
        (F.coalesce(c("schema_version") != FLOW_VERSION, F.lit(True)), "schema_version"),
        (~fn.is_uuid7(c("id")), "id"),
        (blank("idempotency_key"), "idempotency_key"),
        (~fn.is_uuid7(c("raw_event_id")), "raw_event_id"),
        (~F.coalesce(c("source_type").isin(*SOURCE_TYPES), F.lit(False)), "source_type"),
        (blank("collector_id"), "collector_id"),
        (blank("source_host"), "source_host"),
        (c("ingested_at").isNull(), "ingested_at"),
        (c("normalized_at").isNull(), "normalized_at"),
        (c("event_start_time").isNull(), "event_start_time"),
        (c("event_end_time") < c("event_start_time"), "event_end_time"),
        (c("src_ip_key").isNull() | c("dst_ip_key").isNull(), "ip"),
        (~c("ip_version").isin(4, 6) | (version(c("src_ip_key")) != c("ip_version")) | (version(c("dst_ip_key")) != c("ip_version")), "ip_version"),
        (~F.coalesce(c("transport_protocol").isin(*TRANSPORTS), F.lit(False)), "transport_protocol"),
        (~F.coalesce(c("direction").isin(*DIRECTIONS), F.lit(False)), "direction"),
        (~F.coalesce(c("normalization_status").isin("ok", "partial"), F.lit(False)), "normalization_status"),
        (c("attributes").isNull(), "attributes"),
        (c("transport_protocol").isin("tcp", "udp") & (c("src_port").isNull() | c("dst_port").isNull()) & (c("normalization_status") != "partial"), "ports"),
        (~c("src_port").between(0, 65535) | ~c("dst_port").between(0, 65535) | ~c("protocol_number").between(0, 255), "range"),
        ((c("bytes") < 0) | (c("packets") < 0) | (c("duration_ms") < 0) | (c("sampling_rate") <= 0), "range"),
    )


def rest(records: DataFrame, networks: tuple[str, ...] = LOCAL_NETWORKS) -> DataFrame:
    """From ENVELOPE columns and a struct `rest` (sources.rest) to FLOW and `error`."""
    from ..sources.rest import error

    c = lambda name: F.col(f"rest.{name}")
    start, end = fn.time_of(c("event_start_time")), fn.time_of(c("event_end_time"))
    name, number = fn.transport(c("transport_protocol")), c("protocol_number")
    partial = lambda n: F.coalesce(F.get_json_object(c("attributes"), f"$.{n}_partial") == "true", F.lit(False))
    reasons = F.array_compact(F.array(F.when(partial("bytes"), "bytes_partial"), F.when(partial("packets"), "packets_partial")))
    return _finish(records.withColumns({
        "error": error(), "event_start_time": start, "event_end_time": end, "duration_ms": F.unix_millis(end) - F.unix_millis(start),
        "src_raw": c("src_ip"), "dst_raw": c("dst_ip"), "src_port": c("src_port").cast("int"), "dst_port": c("dst_port").cast("int"),
        "transport_protocol": name, "protocol_number": F.coalesce(number.try_cast("smallint"), fn.protocol_number(name)),
        "bytes": c("bytes").try_cast("bigint"), "packets": c("packets").try_cast("bigint"), "tcp_flags": c("tcp_flags").try_cast("int"), "flow_state": _null("string"),
        "input_interface": _null("bigint"), "output_interface": _null("bigint"), "next_hop_ip": _null("string"),
        "application_protocol": F.nullif(F.trim(c("application_protocol")), F.lit("")), "sampling_rate": c("sampling_rate"),
        "attributes": c("attributes"), "native": F.nullif(c("external_id"), F.lit("")), "reasons": reasons,
    }), networks, nanos=(fn.nanos_of(c("event_start_time")), fn.nanos_of(c("event_end_time"))))


def zeek(records: DataFrame, networks: tuple[str, ...] = LOCAL_NETWORKS) -> DataFrame:
    """From ENVELOPE columns and a struct `zeek` (sources.zeek). Bytes and packets need both sides."""
    c = lambda name: F.col(f"zeek.{name}")
    start = F.timestamp_micros(F.round(c("ts") * 1_000_000).cast("bigint"))
    duration = F.when(c("duration") >= 0, F.round(c("duration") * 1000).cast("bigint"))
    name = fn.transport(c("proto"))
    name = F.when(name.isNull() | (name == "unknown"), "other").otherwise(name)
    total = lambda what: (c(f"orig_{what}") + c(f"resp_{what}")).try_cast("bigint")
    lost = {"bytes_partial": c("orig_bytes").isNull() | c("resp_bytes").isNull(), "packets_partial": c("orig_pkts").isNull() | c("resp_pkts").isNull()}
    lost["ports_missing"] = name.isin("tcp", "udp") & (c("id_orig_p").isNull() | c("id_resp_p").isNull())
    own = _attributes(local_orig=c("local_orig"), local_resp=c("local_resp"), history=c("history"), **{k: F.when(bad, "true") for k, bad in lost.items()})
    return _finish(records.withColumns({
        "error": c("error"), "event_start_time": start, "event_end_time": F.timestamp_micros(F.unix_micros(start) + duration * 1000), "duration_ms": duration,
        "src_raw": c("id_orig_h"), "dst_raw": c("id_resp_h"), "src_port": c("id_orig_p").try_cast("int"), "dst_port": c("id_resp_p").try_cast("int"),
        "transport_protocol": name, "protocol_number": fn.protocol_number(name), "bytes": total("bytes"), "packets": total("pkts"), "tcp_flags": _null("int"),
        "flow_state": c("conn_state"), "input_interface": _null("bigint"), "output_interface": _null("bigint"), "next_hop_ip": _null("string"),
        "application_protocol": c("service"), "sampling_rate": _null("bigint"),
        "attributes": F.to_json(F.map_concat(F.map_filter(F.coalesce(F.from_json(c("extra"), "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>")), lambda k, _: ~k.isin("local_orig", "local_resp", "history", *lost)), F.transform_values(own, lambda _, v: v.cast("variant")))),
        "native": F.coalesce(F.nullif(c("uid"), F.lit("")), F.concat(F.lit("zeek:"), F.col("source_host"), F.lit(":"), fn.rfc3339(start))),
        "reasons": F.array_compact(F.array(*[F.when(bad, k) for k, bad in lost.items()])),
    }), networks)


def _switched(received: Column, exporter: Column, uptime: Column, first: Column, last: Column, strict: bool) -> tuple[Column, Column, Column]:
    """(start, end, fallback): export time less what had passed since the switch; else the time of receipt."""
    known = exporter.isNotNull() & (uptime > 0) & first.isNotNull() & last.isNotNull() & (first <= uptime) & (last <= uptime)
    known = F.coalesce(known & (last >= first) if strict else known, F.lit(False))
    at = lambda switched: F.timestamp_micros(F.unix_micros(exporter) - (uptime - switched) * 1000)
    return F.when(known, at(first)).otherwise(received), F.when(known, at(last)), ~known


def netflow5(records: DataFrame, networks: tuple[str, ...] = LOCAL_NETWORKS) -> DataFrame:
    """From ENVELOPE columns and a struct `v5` (sources.netflow5)."""
    c = lambda name: F.col(f"v5.{name}")
    start, end, fallback = _switched(F.col("received_at"), c("exporter_time"), c("exporter_uptime_ms"), c("first_switched_ms"), c("last_switched_ms"), False)
    name = fn.protocol_name(c("protocol_number"))
    own = _attributes(tos=c("tos"), src_as=c("src_as"), dst_as=c("dst_as"), src_mask=c("src_mask"), dst_mask=c("dst_mask"), engine_type=c("engine_type"), engine_id=c("engine_id"), timestamp_fallback=F.when(fallback, "received_at"))
    duration = F.unix_millis(end) - F.unix_millis(start)
    return _finish(records.withColumns({
        "error": _null("string"), "event_start_time": start, "event_end_time": end, "duration_ms": F.when(duration >= 0, duration), "src_raw": c("src_addr"), "dst_raw": c("dst_addr"),
        "src_port": c("src_port").cast("int"), "dst_port": c("dst_port").cast("int"), "transport_protocol": name,
        "protocol_number": F.when(name == "unknown", 0).otherwise(c("protocol_number")).cast("smallint"), "bytes": c("bytes"), "packets": c("packets"),
        "tcp_flags": c("tcp_flags").cast("int"), "flow_state": _null("string"), "input_interface": c("input_interface"), "output_interface": c("output_interface"),
        "next_hop_ip": F.nullif(c("next_hop"), F.lit("0.0.0.0")), "application_protocol": _null("string"), "sampling_rate": c("sampling_rate"), "attributes": F.to_json(own),
        "native": F.concat_ws(":", F.coalesce("source_ip", F.lit("")), c("packet_sequence"), c("record_index")),
        "reasons": F.array_compact(F.array(F.when(fallback, "timestamp_fallback"))),
    }), networks, (c("src_key"), c("dst_key")))


def netflow9(records: DataFrame, networks: tuple[str, ...] = LOCAL_NETWORKS) -> DataFrame:
    """From ENVELOPE columns and those of sources.netflow9. Records without IPv4 addresses are errors; missing counters are 0."""
    get = lambda k: F.col("fields")[F.lit(k)]
    num = lambda k: get(k).try_cast("bigint")
    start, end, fallback = _switched(F.col("received_at"), F.col("exporter_time"), F.col("exporter_uptime_ms"), num(22), num(21), True)
    name = fn.protocol_name(F.coalesce(num(4), F.lit(0)))
    own = _attributes(tos=get(5), source_id=F.col("source_id"), template_id=F.col("template_id"), record_index=F.col("record_index"), timestamp_fallback=F.when(fallback, "received_at"))
    missing = F.when(get(8).isNull() | get(12).isNull(), "address_missing")
    return _finish(records.withColumns({
        "error": F.coalesce(F.col("error"), missing), "event_start_time": start, "event_end_time": end, "duration_ms": F.unix_millis(end) - F.unix_millis(start),
        "src_raw": get(8), "dst_raw": get(12), "src_port": num(7).try_cast("int"), "dst_port": num(11).try_cast("int"), "transport_protocol": name,
        "protocol_number": F.when(name == "unknown", 0).otherwise(num(4)).cast("smallint"), "bytes": F.coalesce(num(1), F.lit(0)), "packets": F.coalesce(num(2), F.lit(0)),
        "tcp_flags": F.nullif(num(6), F.lit(0)).try_cast("int"), "flow_state": _null("string"), "input_interface": num(10), "output_interface": num(14), "next_hop_ip": get(15),
        "application_protocol": _null("string"), "sampling_rate": _null("bigint"), "attributes": F.to_json(own),
        "native": F.concat_ws(":", F.coalesce("source_ip", F.lit("")), F.col("packet_sequence"), F.col("record_index")),
        "reasons": F.array_compact(F.array(F.when(fallback, "timestamp_fallback"))),
    }), networks)


def split(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flows, dead letters)."""
    return normalized.where("error is null").drop("error"), dead_letters(normalized.where("error is not null"), "normalizer")


def dead_letters(bad: DataFrame, stage: str, payload: str | None = None, most: int = 1500) -> DataFrame:
    """stage, error_code, raw_event_id, payload (its first bytes), payload_sha256, payload_size, truncated."""
    raw = (F.col(payload) if payload else F.to_json(F.struct(*[F.col(c) for c in bad.columns if c != "error"]))).cast("binary")
    event = F.col("raw_event_id") if "raw_event_id" in bad.columns else _null("string")
    return bad.select(F.lit(stage).alias("stage"), F.col("error").alias("error_code"), event.alias("raw_event_id"), F.substring(raw, F.lit(1), F.lit(most)).alias("payload"), F.sha2(raw, 256).alias("payload_sha256"), F.octet_length(raw).cast("bigint").alias("payload_size"), (F.octet_length(raw) > most).alias("truncated"))
