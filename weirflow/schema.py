"""Fixed schemas. Inputs are read with these, never inferred."""

from __future__ import annotations

FLOW_VERSION, RAW_VERSION = "flow.v1", "raw.v1"

# Closed sets of the flow model.
SOURCE_TYPES = ("netflow_v5", "netflow_v9", "zeek_conn_json", "suricata_eve_json", "rest_json", "syslog_cef", "syslog_leef")
TRANSPORTS = ("tcp", "udp", "icmp", "gre", "esp", "other", "unknown")
DIRECTIONS = ("inbound", "outbound", "internal", "external", "unknown")
PROTOCOLS = {0: "unknown", 1: "icmp", 6: "tcp", 17: "udp", 47: "gre", 50: "esp"}
LOCAL_NETWORKS = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")

#: One flow. src_ip_key and dst_ip_key are the addresses as 4 or 16 bytes, which order and compare as networks do.
FLOW = """
id string, schema_version string, idempotency_key string, raw_event_id string, source_type string, collector_id string, source_host string,
source_ip string, ingested_at timestamp, normalized_at timestamp, event_start_time timestamp, event_end_time timestamp, duration_ms bigint,
src_ip string, dst_ip string, src_ip_key binary, dst_ip_key binary, src_port int, dst_port int, ip_version smallint, transport_protocol string,
protocol_number smallint, bytes bigint, packets bigint, tcp_flags int, flow_state string, direction string, input_interface bigint,
output_interface bigint, next_hop_ip string, application_protocol string, sampling_rate bigint, normalization_status string,
normalization_error string, attributes string
"""
FLOW_COLUMNS = tuple(part.split()[0] for part in FLOW.replace("\n", " ").split(","))

#: What every source adds to its records: who sent them, and when they came.
ENVELOPE = "event_id string, source_type string, collector_id string, source_host string, source_ip string, received_at timestamp"

REST_RECORD = """
external_id string, event_start_time string, event_end_time string, src_ip string, dst_ip string, src_port bigint, dst_port bigint,
transport_protocol string, protocol_number bigint, bytes decimal(20,0), packets decimal(20,0), application_protocol string, tcp_flags bigint,
sampling_rate bigint, attributes string
"""

REST_FIELDS = tuple(part.split()[0] for part in REST_RECORD.replace("\n", " ").replace("(20,0)", "").split(","))

#: The columns of a search result; attributes only on request.
SEARCH_COLUMNS = (
    "id", "schema_version", "idempotency_key", "raw_event_id", "source_type", "collector_id", "source_host", "source_ip", "event_start_time",
    "event_end_time", "duration_ms", "src_ip", "dst_ip", "src_port", "dst_port", "transport_protocol", "protocol_number", "bytes", "packets",
    "direction", "application_protocol", "normalization_status",
)
