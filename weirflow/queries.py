"""The library's own queries over the driver's tables, each with SQL that must give the same rows.

`events` stands for flows through an adapter of integer expressions, the same in both dialects; addresses are numbers there.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import envelope
from .functions import flow as fn
from .functions.net import direction
from .operators import flows as fl
from .operators import dashboard, logs, metrics, normalize, tiers
from .operators.lineage import cut, new_path
from .sources import netflow5, netflow9, proxy, rest, zeek

Query = Callable[[SparkSession, str], DataFrame]

ADAPTER = """
SELECT event_id AS id, ts AS event_start_time,
  CASE WHEN event_id % 7 = 0 THEN 3221225984 + user_id % 200 ELSE 167772160 + (user_id * 2654435) % 65536 END AS src_ip_key,
  CASE WHEN event_id % 5 = 0 THEN 3232235776 + event_id % 256 ELSE 134744072 + (event_id * 40503) % 4096 END AS dst_ip_key,
  1024 + (event_id * 7919) % 5000 AS src_port,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE 1 + (event_id * 31) % 64 END AS dst_port,
  CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 17 ELSE 6 END AS protocol_number,
  CASE event_type WHEN 'error' THEN 'icmp' WHEN 'signup' THEN 'udp' ELSE 'tcp' END AS transport_protocol,
  CASE WHEN event_id % 3 = 0 THEN 'zeek_conn_json' ELSE 'rest_json' END AS source_type,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value * 100) AS BIGINT) END AS bytes,
  1 + event_id % 50 AS packets
FROM events
"""
SAMPLES = "SELECT ts, event_id, event_type AS metric_name, user_id % 5 AS labels, CAST(floor(value * 100) AS BIGINT) AS value FROM events"
_WITH = f"WITH flows AS ({ADAPTER}), samples AS ({SAMPLES})\n"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def flows(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(ADAPTER.replace("FROM events", "FROM {events}"), events=_events(spark, d))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(SAMPLES.replace("FROM events", "FROM {events}"), events=_events(spark, d))


def _t(day: int, hour: int = 0, minute: int = 0) -> datetime:
    return datetime(2024, 1, day, hour, minute)


WEEK = (_t(2), _t(9))
HALF_DAY = (_t(5, 0, 30), _t(5, 12, 30))
SIX_HOURS = (_t(5, 0, 30), _t(5, 6, 30))


def _between(span: tuple[datetime, datetime], column: str = "event_start_time") -> str:
    return f"{column} >= TIMESTAMP '{span[0]}' AND {column} < TIMESTAMP '{span[1]}'"


_COLUMNS = ("id", "source_type", "event_start_time", "src_port", "dst_port", "transport_protocol", "protocol_number", "bytes", "packets")


def _search(limit: int = 100, span: tuple = WEEK, cursor: tuple | None = None, **filters) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        at = (F.lit(str(cursor[0])).cast("timestamp_ntz"), cursor[1]) if cursor else None
        return fl.search(flows(spark, d), fl.Filters(*span, **filters), limit, at)

    return run


def _search_sql(where: str = "true", limit: int = 100, span: tuple = WEEK) -> str:
    return _WITH + f"SELECT {', '.join(_COLUMNS)} FROM flows WHERE {_between(span)} AND {where} ORDER BY event_start_time DESC, id DESC LIMIT {limit + 1}"


def _top(keys: tuple[str, ...], metric: str = "bytes", span: tuple = WEEK, which: str = "auto", limit: int = 20, cursor: tuple | None = None, **filters) -> Query:
    return lambda spark, d: fl.top(fl.Tables(flows(spark, d)), fl.TopK(fl.Filters(*span, **filters), keys, metric, limit, which, cursor))


def _top_sql(keys: tuple[str, ...], metric: str = "bytes", span: tuple = WEEK, which: str = "1h", limit: int = 20, where: str = "true", having: str = "true") -> str:
    names = ", ".join(keys)
    tier_keys = fl.PORTS if any("port" in k for k in keys) else fl.TALKERS
    value = {"bytes": "bytes", "packets": "packets", "flows": "1"}[metric]
    if which == "raw":
        rows = f"SELECT {names}, {value} AS v, 1 AS n FROM flows WHERE {_between(span)} AND {where}"
    else:
        width = {"5m": "5 minutes", "1h": "1 hour"}[which]
        rows = f"SELECT * FROM (SELECT time_bucket(INTERVAL '{width}', event_start_time) AS bucket, {', '.join(tier_keys)}, sum({value}) AS v, count(*) AS n FROM flows GROUP BY ALL) WHERE {_between(span, 'bucket')} AND {where}"
    ports = " AND ".join(f"{k} IS NOT NULL" for k in keys if k.endswith("port")) or "true"
    return _WITH + f"SELECT * FROM (SELECT {names}, sum(v)::BIGINT AS value, sum(n)::BIGINT AS flow_count FROM ({rows}) WHERE v IS NOT NULL AND {ports} GROUP BY {names}) WHERE {having} ORDER BY value DESC, flow_count DESC, {names} LIMIT {limit + 1}"


def _tier(width: str, keys: tuple[str, ...]) -> Query:
    return lambda spark, d: fl.tier(flows(spark, d), width, keys)


def _tier_sql(width: str, keys: tuple[str, ...]) -> str:
    return _WITH + f"SELECT time_bucket(INTERVAL '{fl.WIDTHS[width]}', event_start_time) AS bucket, {', '.join(keys)}, sum(bytes)::BIGINT AS total_bytes, sum(packets)::BIGINT AS total_packets, count(*) AS flow_count FROM flows GROUP BY ALL"


def _partial_tier(kind: str, width: str) -> Query:
    """A tier of three batches whose partial sums are noted, the first two folded into their days, the last one still late."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        path, f = new_path(spark, "tiers"), flows(spark, d)
        for batch in range(3):
            tiers.note(f.where(F.col("id") % 3 == batch), path, batch)
            if batch == 1:
                tiers.fold(spark, path)
        return tiers.current(spark, path, kind, width)

    return run


_SRC, _DST = ("src_ip_key",), ("dst_ip_key",)
_PROTO = ("protocol_number", "transport_protocol")


def _direction(spark: SparkSession, d: str) -> DataFrame:
    got = direction(F.col("src_ip_key"), F.col("dst_ip_key"), as_number=True)
    return flows(spark, d).groupBy(got.alias("direction")).agg(F.count("*").alias("flow_count"))


_LOCAL = "({0} BETWEEN 167772160 AND 184549375 OR {0} BETWEEN 2886729728 AND 2887778303 OR {0} BETWEEN 3232235520 AND 3232301055)"


def _wide(spark: SparkSession, d: str) -> DataFrame:
    """Events with all columns that a flow's keys are made of; start times have nanoseconds beyond their microseconds."""
    ip = lambda k: F.concat_ws(".", *[F.shiftright(F.col(k).cast("bigint"), n).bitwiseAND(255).cast("string") for n in (24, 16, 8, 0)])
    return flows(spark, d).withColumns({
        "schema_version": F.lit("flow.v1"), "collector_id": F.lit("main"), "source_host": F.concat(F.lit("h"), F.col("id") % 3), "event_end_time": F.when(F.col("id") % 4 > 0, F.timestamp_add("SECOND", F.lit(5), F.col("event_start_time"))),
        "src_ip": ip("src_ip_key"), "dst_ip": ip("dst_ip_key"), "nanos": (F.col("id") % 3 * 7).cast("int"),
    })


def _idempotency(spark: SparkSession, d: str) -> DataFrame:
    key = fn.idempotency_key(F.coalesce(F.when(F.col("id") % 5 > 0, F.concat(F.lit("e"), F.col("id"))), fn.tuple_identity()), F.col("nanos"))
    return _wide(spark, d).select("id", key.alias("idempotency_key"))


_SQL_TIME = "CASE WHEN {0} IS NOT NULL THEN rtrim(rtrim(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z' ELSE '' END"
_SQL_NANOS = "rtrim(rtrim(strftime(event_start_time, '%Y-%m-%dT%H:%M:%S.%f') || lpad((id % 3 * 7)::VARCHAR, 3, '0'), '0'), '.') || 'Z'"
_SQL_IP = "({0} // 16777216) || '.' || ({0} // 65536 % 256) || '.' || ({0} // 256 % 256) || '.' || ({0} % 256)"
_IDEMPOTENCY_SQL = _WITH + f""", wide AS (
  SELECT *, CASE WHEN id % 4 > 0 THEN event_start_time + INTERVAL 5 SECOND END AS event_end_time, {_SQL_IP.format('src_ip_key')} AS src_ip, {_SQL_IP.format('dst_ip_key')} AS dst_ip FROM flows)
SELECT id, 'sha256:' || sha256(concat_ws('|', 'flow.v1', source_type, 'main', 'h' || id % 3,
  CASE WHEN id % 5 > 0 THEN 'e' || id ELSE 'tuple:' || sha256(concat_ws('|', {_SQL_TIME.format('event_start_time')}, src_ip, dst_ip, protocol_number::VARCHAR)) END,
  {_SQL_NANOS}, {_SQL_TIME.format('event_end_time')}, src_ip, dst_ip, coalesce(src_port::VARCHAR, ''), coalesce(dst_port::VARCHAR, ''), protocol_number::VARCHAR,
  coalesce(bytes::VARCHAR, ''), packets::VARCHAR)) AS idempotency_key FROM wide"""


def _projection(spark: SparkSession, d: str) -> DataFrame:
    """All columns of a search result, in a table that has more."""
    c = F.col
    wide = _wide(spark, d).withColumns({
        "idempotency_key": F.concat(F.lit("k"), c("id")), "raw_event_id": F.concat(F.lit("r"), c("id")), "source_ip": F.lit(None).cast("string"), "duration_ms": F.lit(5), "direction": F.lit("outbound"),
        "application_protocol": F.lit("dns"), "normalization_status": F.lit("ok"), "attributes": F.lit("{}"), "tcp_flags": F.lit(1), "ingested_at": c("event_start_time"), "ip_version": F.lit(4),
    })
    return fl.search(wide, fl.Filters(*WEEK), 100, attributes=True)


def _uuid(spark: SparkSession, d: str) -> DataFrame:
    made = fn.uuid7(F.col("event_start_time").cast("timestamp"), F.concat(F.lit("s"), F.col("id")))
    return flows(spark, d).select("id", made.alias("uuid"), fn.is_uuid7(made).alias("valid"), fn.is_uuid7(F.regexp_replace(made, "-7", "-4")).alias("other"))


def _masks(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string('{"n":%d,"x-api-key":"a","in":[{"session":%d},{"safe_token":1}],"safe":"b"}', F.col("id"), F.col("id"))
    return flows(spark, d).select("id", fn.mask_json(text).alias("masked"), fn.sensitive(F.element_at(F.array(*[F.lit(x) for x in ("auth", "auth_x", "author", "X Token", "tokens")]), (F.col("id") % 5 + 1).cast("int"))).alias("sensitive"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    m = F.create_map(F.lit("b"), F.concat(F.lit('x"'), F.col("id")), F.lit("a"), F.lit("\\"))
    return flows(spark, d).select("id", fn.labels_key(m).alias("key"), fn.labels_text(m).alias("text"))


def _exposition(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as text lines and read again."""
    s = samples(spark, d).select("metric_name", F.create_map(F.lit("user"), F.col("labels").cast("string"), F.lit("q"), F.lit('a"\\b')).alias("labels"), F.col("value").cast("double").alias("value"))
    back = metrics.read_exposition(metrics.exposition(s).withColumnRenamed("line", "value"))
    return back.groupBy("metric_name", F.col("labels")["user"].alias("user"), F.col("labels")["q"].alias("q")).agg(F.count("*").alias("lines"), F.sum("value").cast("bigint").alias("total"))


def _restarts(spark: SparkSession, d: str) -> DataFrame:
    p = flows(spark, d).select("id", (F.col("src_port") % 10).alias("source_ip"), (F.col("id") * 37 % 5000).alias("sequence"), (F.col("id") * 91 % 7000).alias("uptime_ms"), F.col("event_start_time").alias("export_time"), F.col("event_start_time").alias("received_at"))
    return netflow5.restarts(p, order=("received_at", "id")).groupBy("source_ip").agg(F.count_if("restarted").alias("restarts"))


def _route(spark: SparkSession, d: str) -> DataFrame:
    p = flows(spark, d).select(F.unhex(F.concat(F.lpad(F.hex(F.col("id") % 12), F.when(F.col("id") % 50 == 0, 2).otherwise(4), "0"), F.lit(""))).alias("packet"))
    return netflow5.route(p).groupBy("kind").agg(F.count("*").alias("packets"))


def _zeek_batch(spark: SparkSession, d: str) -> DataFrame:
    """Requests of an object, a line as a string, a null and a blank string, each read and parsed."""
    line = F.format_string('{"ts":1700000000.5,"id.orig_h":"10.0.0.1","id.resp_h":"8.8.8.8","proto":"tcp","id.orig_p":%d,"uid":"C%d"}', "src_port", "id")
    request = F.concat(F.lit('{"records":['), line, F.lit(","), F.to_json(F.array(line)).substr(F.lit(2), F.length(F.to_json(F.array(line))) - 2), F.lit(',null,"  "]}'))
    got = zeek.parse(zeek.explode(flows(spark, d).select("id", request.alias("value"))), "line")
    return got.select("id", "record_index", F.col("zeek.id_orig_p").alias("src_port"), F.col("zeek.uid").alias("uid"), F.coalesce("request_error", "zeek.error").alias("error"))


def _proxy(spark: SparkSession, d: str) -> DataFrame:
    """Batches of one record of each sort: sound, bad base64, bad address, unknown version; times invalid, future, old and sound."""
    version = F.when(F.col("id") % 4 == 3, "0004").otherwise("0005")
    data = F.when(F.col("id") % 4 == 1, "!!").otherwise(F.base64(F.unhex(F.concat(version, F.lit("0001")))))
    times = F.array(*[F.lit(x) for x in ("2024-01-10T00:00:00Z", "bad", "2024-01-10T00:05:01Z", "2024-01-08T23:59:59Z", "2024-01-10T02:00:00.25+02:00")])
    record = F.struct(data.alias("packet_data"), F.when(F.col("id") % 4 == 2, "10.0.0.300").otherwise("10.0.0.3").alias("source_ip"), F.element_at(times, (F.col("id") % 5 + 1).cast("int")).alias("received_at"))
    rows = proxy.accept(proxy.explode(flows(spark, d).select(F.to_json(F.struct(F.array(record, record).alias("records"))).alias("value"))), F.lit("2024-01-10 00:00:00").cast("timestamp"))
    return rows.groupBy("record_index", "status", "error_code", "timestamp_reason", (F.unix_millis("proxy_received_at")).alias("at_ms")).agg(F.count("*").alias("records"))


_PROXY_SQL = _WITH + """SELECT i AS record_index, CASE WHEN id % 4 = 0 THEN 'accepted' ELSE 'rejected' END AS status,
  CASE id % 4 WHEN 1 THEN 'invalid_base64' WHEN 2 THEN 'invalid_source_ip' WHEN 3 THEN 'unsupported_version' END AS error_code,
  CASE id % 5 WHEN 1 THEN 'invalid' WHEN 2 THEN 'future' WHEN 3 THEN 'old' END AS timestamp_reason,
  CASE id % 5 WHEN 0 THEN 1704844800000 WHEN 4 THEN 1704844800250 END AS at_ms, count(*) AS records FROM flows, range(2) r(i) GROUP BY ALL"""


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes that each break one rule, or none; then how many there are of each outcome."""
    n = F.col("id") % 14
    field = lambda bad: F.array(F.named_struct(F.lit("field_id"), F.when(bad, 0).otherwise(8).cast("bigint"), F.lit("field_length"), F.lit(4).cast("bigint"), F.lit("name"), F.lit(None).cast("string"),
                                           F.lit("unsigned_value"), F.lit(None).cast("decimal(20,0)"), F.lit("string_value"), F.when(n == 13, "1.2.3").otherwise("10.0.0.1"), F.lit("bytes_value"), F.lit(None).cast("binary")))
    good = lambda at, value, bad=None: F.when(n == at, F.lit(bad)).otherwise(value)
    rows = flows(spark, d).select(
        good(0, F.format_string("01934d7c-79b4-7000-8b69-%012x", "id")).alias("event_id"), good(1, F.lit("raw.v1"), "raw.v2").alias("schema_version"), good(2, F.lit("main"), " ").alias("collector_id"),
        F.when(n == 3, None).when(n == 4, "other").when(n == 5, "suricata_eve_json").otherwise("netflow_v9").alias("source_type"), good(6, F.lit("h")).alias("source_host"),
        good(7, F.col("event_start_time")).alias("received_at"), F.when(n == 2, " :h").when(n == 6, "main:").when(n == 8, "x").otherwise("main:h").alias("partition_key"),
        F.when(n == 9, None).when(n == 10, "syslog").otherwise("netflow_v9").alias("payload"), field(n == 11).alias("fields"))
    return rows.groupBy(F.coalesce(envelope.error(F.col("fields")), F.lit("ok")).alias("outcome")).agg(F.count("*").alias("events"))


_ENVELOPES_SQL = _WITH + """SELECT ['event_id', 'schema_version', 'collector_id', 'source_type', 'unknown_source_type', 'payload_undefined', 'source_host', 'received_at', 'partition_key', 'payload_missing',
  'payload_mismatch', 'decoded_fields', 'ok', 'decoded_fields'][1 + id % 14] AS outcome, count(*) AS events FROM flows GROUP BY ALL"""


#: Fields of the two layouts that templates of `_v9_packets` have in turn: half days before and from noon on.
_V9_LAYOUTS = (((8, 4), (12, 4), (7, 2), (4, 1), (2, 4), (1, 8)), ((12, 4), (1, 8), (8, 4), (2, 4), (4, 1), (7, 2)))


def _v9_packets(spark: SparkSession, d: str) -> DataFrame:
    """All events as NetFlow v9: of each exporter, one event a packet, and templates in packets of their own.

    Each day an exporter restarts: uptime and sequence fall below all of the day before. Templates come again with each hour, the first of
    a morning only 20 seconds after its first data. At noon the template is redefined with its fields in another order. An options template has
    the same id, and another one (300) comes with its record: the interval is the number of the half day, interface 1 or 2 is if1 or if2.
    """
    c, size = F.col, 7
    hexed = lambda x, n: F.lpad(F.hex(x.cast("bigint")), 2 * n, "0")
    short = lambda *numbers: "".join(f"{n:04x}" for n in numbers)
    f = flows(spark, d).withColumns({"source_ip": (c("src_port") % 20).cast("string"), "at": c("event_start_time").cast("timestamp")})
    seconds, day = F.unix_seconds(c("at")), F.floor(F.unix_seconds(c("at")) / 86400)
    half = F.floor(seconds / 43200)
    falling = seconds - 2 * 86400 * day + F.lit(40_000 * 86400)
    head = lambda count: F.concat(F.lit(short(9, count)), hexed(falling, 4), hexed(seconds, 4), hexed(falling, 4), hexed(F.lit(size), 4))
    values = {8: "src_ip_key", 12: "dst_ip_key", 7: "src_port", 4: "protocol_number", 2: "packets", 1: "id"}
    body = lambda layout: F.concat(*[hexed(c(values[k]), n) for k, n in layout])
    wide = sum(n for _, n in _V9_LAYOUTS[0])
    data = F.concat(head(1), F.lit(short(256, wide + 4)), F.when(half % 2 == 0, body(_V9_LAYOUTS[0])).otherwise(body(_V9_LAYOUTS[1])))

    fields = lambda layout: F.lit(short(0, 8 + 4 * len(layout), 256, len(layout)) + "".join(short(*x) for x in layout))
    others = F.lit(short(1, 4 + 14 + 18, 256, 4, 4, 2, 2, 34, 2, 300, 4, 8, 2, 4, 34, 4, 82, 4))
    record = F.concat(F.lit(short(300, 16)), hexed(half % 2 + 1, 4), hexed(half, 4), F.lit("6966"), hexed(half % 2 + 49, 1), F.lit("00"))
    template = F.concat(head(4), F.when(half % 2 == 0, fields(_V9_LAYOUTS[0])).otherwise(fields(_V9_LAYOUTS[1])), others, record)
    hour = F.date_trunc("hour", "at")
    hours = f.groupBy("source_ip", hour.alias("hour")).agg(F.min("at").alias("first"))
    known = hours.withColumn("opens", F.min("hour").over(Window.partitionBy("source_ip", F.to_date("hour"))) == c("hour"))
    late = c("opens") & (F.hour("hour") < 12)
    known = known.select("source_ip", F.when(late, F.least(F.timestamp_add("SECOND", F.lit(20), c("first")), F.expr("hour + interval 1 hour - interval 1 microsecond"))).otherwise(c("hour")).alias("at"))
    both = f.select("source_ip", F.unhex(data).alias("packet"), "at", c("id").alias("arrival")).unionByName(known.select("source_ip", F.unhex(template).alias("packet"), "at", F.lit(-1).cast("bigint").alias("arrival")))
    return cut(both.select(F.lit("main").alias("collector_id"), F.lit("h").alias("source_host"), "source_ip", F.lit(size).cast("bigint").alias("source_id"), "packet", c("at").alias("received_at"), "arrival"))


def _netflow9(spark: SparkSession, d: str) -> DataFrame:
    c, v = F.col, lambda k: F.col("fields")[k]
    got = netflow9.parse(_v9_packets(spark, d))
    return got.select("source_ip", v(1).cast("bigint").alias("id"), c("packet_sequence").alias("sequence"), "record_index", v(8).alias("src_ip"), v(12).alias("dst_ip"), v(7).cast("int").alias("src_port"), v(4).cast("int").alias("protocol_number"), v(2).cast("bigint").alias("packets"), "error")


_NETFLOW9_SQL = _WITH + f"""SELECT (src_port % 20)::VARCHAR AS source_ip, id, s - 2 * 86400 * (s // 86400) + 40000::BIGINT * 86400 AS sequence, 0 AS record_index, {_SQL_IP.format('src_ip_key')} AS src_ip, {_SQL_IP.format('dst_ip_key')} AS dst_ip,
  src_port::INT AS src_port, protocol_number, packets, NULL AS error FROM (SELECT *, floor(epoch(event_start_time))::BIGINT AS s FROM flows)"""


def _v9_sampling(spark: SparkSession, d: str) -> DataFrame:
    got = netflow9.sampling(_v9_packets(spark, d))
    return got.select("source_ip", "interval", "algorithm", "sampler", F.array_join(F.array_sort(F.map_values("interfaces")), ",").alias("interfaces"))


_V9_SAMPLING_SQL = _WITH + """, h AS (SELECT DISTINCT (src_port % 20)::VARCHAR AS source_ip, floor(epoch(event_start_time))::BIGINT // 43200 AS half FROM flows)
SELECT source_ip, max(half) AS interval, NULL AS algorithm, NULL AS sampler, string_agg('if' || (half % 2 + 1), ',' ORDER BY half) AS interfaces
FROM h WHERE half // 2 = (SELECT max(x.half) // 2 FROM h x WHERE x.source_ip = h.source_ip) GROUP BY source_ip"""


_CHART = {0: "flow_records_normalized_total", 1: "flow_records_stored_total", 2: "flow_records_failed_total", 3: "rate_limit_rejections_total", 4: "kafka_consumer_lag", 5: "storage_insert_duration", 6: "unknown_metric"}
_POINTS_SQL = "SELECT ts AS bucket, event_id AS id, CASE event_id % 7 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _CHART.items()) + """ END AS metric_name, user_id % 5 AS user,
  CAST(event_id % 90 AS BIGINT) - 5 AS delta, CASE WHEN event_id % 4 > 0 THEN CAST(floor(value * 100) AS DOUBLE) END AS avg, CAST(floor(value * 10) AS DOUBLE) AS last, CAST(NULL AS DOUBLE) AS max,
  CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 50 AS DOUBLE) END AS p90, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 60 AS DOUBLE) END AS p95, CAST(event_id % 70 AS DOUBLE) AS p99, CAST(event_id % 9 AS BIGINT) AS count FROM events"""


def _chart(spark: SparkSession, d: str) -> DataFrame:
    """Events as points of the charts' metrics."""
    got = spark.sql(_POINTS_SQL.replace("FROM events", "FROM {events}"), events=_events(spark, d))
    user = F.col("user").cast("string")
    return got.withColumn("labels", F.map_filter(F.create_map(F.lit("source_type"), F.element_at(F.array(F.lit("SOURCE_TYPE_REST_JSON"), F.lit(" netflow_v9 "), F.lit("own"), F.lit(None), F.lit("zeek_conn_json")), (F.col("user") + 1).cast("int")), F.lit("reason"), F.when(F.col("user") > 0, user), F.lit("topic"), F.lit("t"), F.lit("partition"), F.when(F.col("user") > 2, user)), lambda _, v: v.isNotNull()))


_SERIES_SQL = f"""WITH p AS ({_POINTS_SQL})
SELECT bucket, 'ingestion' AS widget, CASE WHEN id % 7 = 1 THEN 'Persisted' ELSE coalesce(['REST', 'NetFlow v9', 'own', NULL, 'Zeek'][user + 1], 'unknown_source') END AS series, delta / 10.0::DOUBLE AS value FROM p WHERE id % 7 <= 1
UNION ALL SELECT bucket, 'deadLetter', CASE WHEN id % 7 = 3 THEN 'Rate Limited' WHEN user > 0 THEN user::VARCHAR ELSE 'unknown_reason' END, delta / 10.0::DOUBLE FROM p WHERE id % 7 IN (2, 3)
UNION ALL SELECT bucket, 'kafkaLag', CASE WHEN user > 2 THEN 't:' || user ELSE 't' END, coalesce(avg, last) FROM p WHERE id % 7 = 4
UNION ALL SELECT bucket, 'dbLatency', n, v FROM (SELECT bucket, unnest(['Average', 'p90', 'p95', 'p99']) AS n, unnest([avg, p90, p95, p99]) AS v FROM p WHERE id % 7 = 5) WHERE v IS NOT NULL"""
_SUMMARY_SQL = f"""WITH p AS ({_POINTS_SQL}), g AS (SELECT
  coalesce(sum(greatest(0, delta)) FILTER (id % 7 = 0), 0)::DOUBLE AS a, coalesce(sum(greatest(0, delta)) FILTER (id % 7 = 1), 0)::DOUBLE AS b, coalesce(sum(greatest(0, delta)) FILTER (id % 7 = 2), 0)::DOUBLE AS f, coalesce(sum(greatest(0, delta)) FILTER (id % 7 = 3), 0)::DOUBLE AS r,
  coalesce(max(last) FILTER (id % 7 = 4), 0) AS m, sum(coalesce(avg, last) * greatest(1, count)) FILTER (id % 7 = 4) / sum(greatest(1, count)) FILTER (id % 7 = 4) AS l,
  {', '.join(f"sum({c} * greatest(1, count)) FILTER (id % 7 = 5 AND {c} IS NOT NULL) / sum(greatest(1, count)) FILTER (id % 7 = 5 AND {c} IS NOT NULL) AS x{c}" for c in ('avg', 'p95', 'p99'))}, sum(greatest(0, count))::BIGINT AS n FROM p)
SELECT a AS total_ingested, b AS total_persisted, f AS total_failed, r AS total_rate_limited, round(m, 3) AS max_lag, round(l, 3) AS avg_lag, round(xavg, 3) AS avg_latency_ms, round(xp95, 3) AS p95_latency_ms, round(xp99, 3) AS p99_latency_ms,
  n AS sample_count, round(b / a * 100, 3) AS persist_success_rate, round(a / 604800, 3) AS average_ingest_rate, round(b / 604800, 3) AS average_persist_rate FROM g"""
_LIVE_SQL = f"""WITH p AS ({_POINTS_SQL}), s AS (SELECT (sum(last) FILTER (id % 7 = 4))::DOUBLE AS lag FROM p), r AS (SELECT sum(greatest(0, delta)) / 5.0::DOUBLE AS rate FROM p WHERE id % 7 = 1 GROUP BY bucket ORDER BY bucket DESC LIMIT 1)
SELECT lag, rate AS persist_rate, CASE WHEN lag > 0 AND rate > 0 THEN lag / rate END AS drain_seconds FROM s, r"""


def _metric_query(spark: SparkSession, d: str) -> DataFrame:
    """Points of two metrics from the five-minute tier, percentiles from what the tier stores; rates of counters only."""
    s = metrics.within(samples(spark, d), *HALF_DAY, 300)
    tier = metrics.drain(s, "5 minutes", order=("ts", "event_id")).withColumns({"metric_kind": F.when(F.col("metric_name") == "click", "counter").otherwise("gauge"), "bucket_width_seconds": F.lit(300), "p90": F.col("max").cast("double"), "p95": F.lit(None).cast("double"), "p99": F.lit(None).cast("double")})
    other = tier.withColumn("bucket_width_seconds", F.lit(5))
    got = metrics.points({"5m": (tier.unionByName(other), None)}, metrics.MetricQuery(*HALF_DAY, 3600, ("click", " error ")))
    return _placed(got).select("place", "bucket", "metric_name", "labels", "count", "delta", "rate_avg", "rate_peak", "p90", "p95")


_METRIC_QUERY_SQL = _WITH + f""", base AS (
  SELECT time_bucket(INTERVAL '5 minutes', ts) AS b, metric_name, labels, count(*) AS n, max(value)::DOUBLE AS hi, last(value ORDER BY ts, event_id) - first(value ORDER BY ts, event_id) AS gain FROM samples GROUP BY ALL)
SELECT row_number() OVER (ORDER BY bucket, metric_name, labels) AS place, * REPLACE (CASE WHEN metric_name = 'click' THEN rate_avg END AS rate_avg, CASE WHEN metric_name = 'click' THEN rate_peak END AS rate_peak) FROM (
SELECT time_bucket(INTERVAL '1 hour', b, TIMESTAMP '{HALF_DAY[0]}') AS bucket, metric_name, labels, sum(n)::BIGINT AS count, sum(gain)::BIGINT AS delta, sum(gain) / 3600.0::DOUBLE AS rate_avg,
  max(gain / 300.0::DOUBLE) AS rate_peak, max(hi) AS p90, NULL::DOUBLE AS p95
FROM base WHERE {_between(HALF_DAY, 'b')} AND metric_name IN ('click', 'error') GROUP BY ALL)"""


def _placed(rows: DataFrame) -> DataFrame:
    """The few rows of an answer with `place`, where each stands in the order that they come in."""
    return rows.withColumn("_n", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("_n"))).drop("_n")


def _sorted(spark: SparkSession, d: str) -> DataFrame:
    """The order of pages by bytes; bytes tie, so the rows of a place are told by them alone."""
    got = _placed(fl.sort_rows(fl.search(flows(spark, d), fl.Filters(*WEEK), 100), "bytes", True))
    return got.select("place", F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _first_wins(spark: SparkSession, d: str) -> DataFrame:
    return fl.first_wins(flows(spark, d), ("src_ip_key", "dst_port"), ("event_start_time", "id")).select("id", "src_ip_key", "dst_port")


def _zeek_lines(spark: SparkSession, d: str) -> DataFrame:
    """Connection lines made of events: dotted and aliased names, dashes, secrets in nested objects, and numbers that aren't any or come as text."""
    f, c = flows(spark, d), F.col
    text = lambda x: F.coalesce(x.cast("string"), F.lit('"-"'))
    quoted = lambda x: F.concat(F.lit('"'), x.cast("string"), F.lit('"'))
    pairs = {
        "ts": F.concat(F.lit("17000"), F.lpad((c("id") % 100000).cast("string"), 5, "0"), F.lit(".25")), "uid": quoted(F.concat(F.lit("C"), c("id"))), "id.orig_h": F.lit('"10.0.0.1"'), "id_resp_h": F.lit('"8.8.8.8"'),
        "proto": quoted(c("transport_protocol")), "id.orig_p": F.when(c("id") % 19 == 0, quoted(c("src_port"))).otherwise(c("src_port").cast("string")), "id.resp_p": text(c("dst_port")),
        "orig_bytes": F.when(c("id") % 17 == 0, F.lit('"bad"')).otherwise(text(c("bytes"))), "resp_bytes": c("packets").cast("string"), "service": F.lit("5"), "local_orig": F.when(c("id") % 2 == 0, F.lit("true")).otherwise(F.lit('"true"')),
        "api_token": F.lit('"x"'), "site": F.concat(F.lit('{"password":"y","n":'), c("id"), F.lit("}")), "rtt": F.lit("1.5"),
    }
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in pairs.items()])
    return f.select("id", F.concat(F.lit("{"), body, F.lit("}")).alias("value"))


def _zeek(spark: SparkSession, d: str) -> DataFrame:
    got = zeek.parse(_zeek_lines(spark, d))
    return got.select("id", F.col("zeek.id_orig_p").alias("src_port"), F.col("zeek.id_resp_p").alias("dst_port"), (F.col("zeek.orig_bytes") + F.col("zeek.resp_bytes")).cast("bigint").alias("bytes"), F.col("zeek.local_orig").alias("local_orig"), F.col("zeek.service").alias("service"), F.col("zeek.extra").alias("extra"), F.col("zeek.error").alias("error"))


_ZEEK_SQL = _WITH + """SELECT id, CASE WHEN id % 19 <> 0 THEN src_port END AS src_port, dst_port, CASE WHEN id % 17 <> 0 THEN bytes + packets END AS bytes, CASE WHEN id % 2 = 0 THEN true END AS local_orig, NULL AS service,
  '{"api_token":"***MASKED***","rtt":1.5,"site":{"n":' || id || ',"password":"***MASKED***"}}' AS extra, CASE WHEN id % 17 = 0 OR id % 19 = 0 THEN 'invalid_number' END AS error FROM flows"""


def _rest(spark: SparkSession, d: str) -> DataFrame:
    """REST records made of events, some broken, normalized; then how many flows each outcome has."""
    f = flows(spark, d)
    record = F.struct(F.concat(F.lit("e"), F.col("id")).alias("external_id"), F.concat(F.date_format("event_start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("event_start_time"),
                      F.when(F.col("id") % 10 == 1, "bad").otherwise("192.168.1.10").alias("src_ip"), F.when(F.col("id") % 10 == 2, "10.0.0.9").otherwise("8.8.8.8").alias("dst_ip"),
                      "src_port", F.when(F.col("id") % 10 == 3, 99999).otherwise(F.col("dst_port")).alias("dst_port"), "transport_protocol", "protocol_number", "bytes", "packets",
                      F.lit('{"token":"x","site":{"db_password":"y","n":1}}').alias("attributes"))
    lines = f.select(F.to_json(record).alias("value"), F.format_string("01934d7c-79b4-7000-8b69-%012x", "id").alias("event_id"), F.lit("rest_json").alias("source_type"), F.lit("main").alias("collector_id"), F.lit("host").alias("source_host"), F.lit("203.0.113.10").alias("source_ip"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("received_at"))
    got = normalize.rest(rest.parse(lines))
    return got.groupBy("error", "direction", "transport_protocol", "attributes").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes")).select(F.coalesce("error", F.lit("ok")).alias("outcome"), "direction", "transport_protocol", "attributes", "records", "bytes")


_REST_SQL = _WITH + """, seen AS (
  SELECT *, id % 10 = 1 AS bad_ip,
         transport_protocol IN ('tcp', 'udp') AND (CASE WHEN id % 10 = 3 THEN 99999 ELSE dst_port END IS NULL OR id % 10 = 3) AS bad_port FROM flows)
SELECT CASE WHEN bad_ip THEN 'invalid_src_ip' WHEN bad_port THEN 'invalid_dst_port' WHEN id % 10 = 3 THEN 'range' ELSE 'ok' END AS outcome,
       CASE WHEN bad_ip THEN 'unknown' WHEN id % 10 = 2 THEN 'internal' ELSE 'outbound' END AS direction, transport_protocol,
       '{"site":{"db_password":"***MASKED***","n":1},"token":"***MASKED***"}' AS attributes, count(*) AS records, sum(bytes)::BIGINT AS bytes
FROM seen GROUP BY ALL"""


def _netflow5(spark: SparkSession, d: str) -> DataFrame:
    """Events packed as datagrams of one record, decoded again."""
    hexed = lambda c, n: F.lpad(F.hex(c.cast("bigint")), 2 * n, "0")
    c, zero = F.col, lambda n: F.lit("00" * n)
    parts = [F.lit("00050001"), F.lit("00002710"), F.lit("65920080"), zero(4), hexed(c("id"), 4), zero(4), hexed(c("src_ip_key"), 4), hexed(c("dst_ip_key"), 4), zero(8), hexed(c("packets"), 4), hexed(F.coalesce(c("bytes"), F.lit(0)), 4),
             F.lit("000003E8"), F.lit("000007D0"), hexed(c("src_port"), 2), hexed(F.coalesce(c("dst_port"), F.lit(0)), 2), zero(2), hexed(c("protocol_number"), 1), zero(9)]
    packets = flows(spark, d).select(F.unhex(F.concat(*parts)).alias("packet"))
    v = lambda n: F.col(f"v5.{n}")
    return netflow5.parse(packets)[0].select(v("packet_sequence").alias("id"), v("src_addr").alias("src_ip"), v("src_port").alias("src_port"), v("dst_port").alias("dst_port"), v("bytes").alias("bytes"), v("packets").alias("packets"), v("protocol_number").alias("protocol_number"))


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    p = flows(spark, d).select("id", (F.col("src_port") % 10).alias("source_ip"), (F.col("id") * 37 % 5000).alias("sequence"), (1 + F.col("id") % 30).alias("records"), F.col("event_start_time").alias("received_at"))
    return netflow5.gaps(p, order=("received_at", "id")).groupBy("source_ip").agg(F.sum("lost").alias("lost"), F.count("*").alias("packets"))


def _p95(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nearest_rank(samples(spark, d), 0.95, ("metric_name",), ("ts", "event_id"))


def _rollup(spark: SparkSession, d: str) -> DataFrame:
    """Counters and gauges; all but one metric have histograms, and so percentiles in place of rates."""
    s = metrics.within(samples(spark, d), *HALF_DAY)
    base = metrics.drain(s, order=("ts", "event_id")).withColumn("metric_kind", F.when(F.col("metric_name").isin("click", "error"), "counter").otherwise("gauge"))
    got = metrics.rollup(base, metrics.histogram(s.where("metric_name <> 'click'"), "5 seconds"), *HALF_DAY, step=1200)
    return got.select("bucket", "metric_name", "labels", "count", "sum", "avg", "min", "max", "first", "last", "delta", "rate_avg", "rate_peak", "p90", "p99")


def _bounds_case(v: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} <= {b} THEN {float(b)}" for b in metrics.BOUNDS) + f" ELSE {metrics.LAST_BOUND} END"


_ROLLUP_SQL = _WITH + f""", base AS (
  SELECT time_bucket(INTERVAL '5 seconds', ts) AS b, metric_name, labels, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi,
         first(value ORDER BY ts, event_id) AS f, last(value ORDER BY ts, event_id) AS l FROM samples GROUP BY ALL
), points AS (
  SELECT time_bucket(INTERVAL '20 minutes', b, TIMESTAMP '{HALF_DAY[0]}') AS bucket, metric_name, labels, sum(n)::BIGINT AS count, sum(s)::BIGINT AS sum,
         min(lo) AS min, max(hi) AS max, first(f ORDER BY b) AS first, last(l ORDER BY b) AS last, sum(l - f)::BIGINT AS delta, max((l - f) / 5.0::DOUBLE) AS rate_peak
  FROM base WHERE {_between(HALF_DAY, 'b')} GROUP BY ALL
), ranks AS (
  SELECT time_bucket(INTERVAL '20 minutes', time_bucket(INTERVAL '5 seconds', ts), TIMESTAMP '{HALF_DAY[0]}') AS bucket, metric_name, labels, {_bounds_case('value')} AS bound
  FROM samples WHERE metric_name <> 'click' AND {_between(HALF_DAY, "time_bucket(INTERVAL '5 seconds', ts)")}
), p AS (
  SELECT bucket, metric_name, labels, quantile_disc(bound, 0.9) AS p90, quantile_disc(bound, 0.99) AS p99 FROM ranks GROUP BY ALL
)
SELECT bucket, metric_name, labels, count, sum, sum::DOUBLE / count AS avg, min, max, first, last, delta, CASE WHEN metric_name = 'click' THEN delta / 1200.0::DOUBLE END AS rate_avg, CASE WHEN metric_name = 'click' THEN rate_peak END AS rate_peak, p90, p99
FROM points LEFT JOIN p USING (bucket, metric_name, labels)"""


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    return samples(spark, d).groupBy(F.window("ts", "1 hour")["start"].alias("bucket"), "metric_name").agg(F.sum("value").alias("value"))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).select(F.col("ts").alias("timestamp"), F.col("event_type").alias("level"), F.col("props").alias("message"), F.lit("{}").alias("attributes"), "event_id")
    return logs.search(e, *WEEK, level="click", text='"K": 1', limit=200, ties=("event_id",))


_DAY = (_t(5), _t(6))

QUERIES: dict[str, tuple[Query, str | None]] = {
    "top_talkers_src_bytes": (_top(_SRC), _top_sql(_SRC)),
    "top_talkers_dst_bytes": (_top(_DST), _top_sql(_DST)),
    "top_talkers_src_packets": (_top(_SRC, "packets"), _top_sql(_SRC, "packets")),
    "top_talkers_dst_flows_5m": (_top(_DST, "flows", SIX_HOURS), _top_sql(_DST, "flows", SIX_HOURS, "5m")),
    "top_talkers_unaligned_1h": (_top(_SRC, "flows", HALF_DAY), _top_sql(_SRC, "flows", HALF_DAY)),
    "top_talkers_raw": (_top(_SRC, span=HALF_DAY, which="raw"), _top_sql(_SRC, span=HALF_DAY, which="raw")),
    "top_ports_src": (_top(("src_port",)), _top_sql(("src_port",))),
    "top_ports_dst": (_top(("dst_port",)), _top_sql(("dst_port",))),
    "top_ports_raw_ipfilter": (_top(("dst_port",), "flows", dst_ip="192.168.1.5"), _top_sql(("dst_port",), "flows", which="raw", where="dst_ip_key = 3232235781")),
    "protocols_bytes": (_top(_PROTO), _top_sql(_PROTO)),
    "protocols_packets": (_top(_PROTO, "packets"), _top_sql(_PROTO, "packets")),
    "protocols_flows_5m": (_top(_PROTO, "flows", SIX_HOURS), _top_sql(_PROTO, "flows", SIX_HOURS, "5m")),
    "agg_keyset_ports": (_top(("dst_port",), "flows", cursor=(40, 40, 10)), _top_sql(("dst_port",), "flows", having="value < 40 OR value = 40 AND (flow_count < 40 OR flow_count = 40 AND dst_port > 10)")),
    "agg_keyset_protocols": (_top(_PROTO, "flows", cursor=(10**6, 0, 0, "")), _top_sql(_PROTO, "flows", having="value < 1000000")),
    "search_range": (_search(), _search_sql()),
    "search_cidr": (_search(src_cidr="10.0.0.0/17"), _search_sql("src_ip_key BETWEEN 167772160 AND 167804927")),
    "search_ip": (_search(dst_ip="192.168.1.5"), _search_sql("dst_ip_key = 3232235781")),
    "search_port": (_search(dst_port=17), _search_sql("dst_port = 17")),
    "search_port_range": (_search(src_ports=(2000, 2500)), _search_sql("src_port BETWEEN 2000 AND 2500")),
    "search_protocol": (_search(protocol_number=17, transport_protocol="udp"), _search_sql("protocol_number = 17 AND transport_protocol = 'udp'")),
    "search_source_type": (_search(source_type="zeek_conn_json"), _search_sql("source_type = 'zeek_conn_json'")),
    "search_keyset": (_search(cursor=(_t(6), 10**9)), _search_sql("(event_start_time < TIMESTAMP '2024-01-06' OR event_start_time = TIMESTAMP '2024-01-06' AND id < 1000000000)")),
    "flow_lookup": (lambda s, d: fl.lookup(flows(s, d), 77).select(*_COLUMNS), _WITH + f"SELECT {', '.join(_COLUMNS)} FROM flows WHERE id = 77"),
    "flow_count": (lambda s, d: flows(s, d).agg(F.count("*").alias("flow_count")), _WITH + "SELECT count(*) AS flow_count FROM flows"),
    **{f"tier_{w}_{name}": (_tier(w, keys), _tier_sql(w, keys)) for w in ("5m", "1h") for name, keys in (("talkers", fl.TALKERS), ("ports", fl.PORTS))},
    "direction_infer": (_direction, _WITH + f"SELECT CASE WHEN {_LOCAL.format('src_ip_key')} AND {_LOCAL.format('dst_ip_key')} THEN 'internal' WHEN {_LOCAL.format('src_ip_key')} THEN 'outbound' WHEN {_LOCAL.format('dst_ip_key')} THEN 'inbound' ELSE 'external' END AS direction, count(*) AS flow_count FROM flows GROUP BY ALL"),
    "protocol_map": (lambda s, d: flows(s, d).select("id", fn.protocol_name(F.col("id") % 60).alias("name")), _WITH + "SELECT id, CASE id % 60 WHEN 1 THEN 'icmp' WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 47 THEN 'gre' WHEN 50 THEN 'esp' ELSE 'unknown' END AS name FROM flows"),
    "idempotency_key": (_idempotency, _IDEMPOTENCY_SQL),
    "rfc3339": (lambda s, d: flows(s, d).select("id", fn.rfc3339(F.col("event_start_time")).alias("text")), _WITH + "SELECT id, rtrim(rtrim(strftime(event_start_time, '%Y-%m-%dT%H:%M:%S.%f'), '0'), '.') || 'Z' AS text FROM flows"),
    "dedup_first_wins": (_first_wins, _WITH + "SELECT id, src_ip_key, dst_port FROM flows QUALIFY row_number() OVER (PARTITION BY src_ip_key, dst_port ORDER BY event_start_time, id) = 1"),
    "zeek_parse": (_zeek, _ZEEK_SQL),
    "rest_normalize": (_rest, _REST_SQL),
    "netflow5_decode": (_netflow5, _WITH + "SELECT id, (src_ip_key // 16777216) || '.' || (src_ip_key // 65536 % 256) || '.' || (src_ip_key // 256 % 256) || '.' || (src_ip_key % 256) AS src_ip, src_port, coalesce(dst_port, 0) AS dst_port, coalesce(bytes, 0) AS bytes, packets, protocol_number::BIGINT AS protocol_number FROM flows"),
    "sequence_gaps": (_gaps, _WITH + ", p AS (SELECT src_port % 10 AS source_ip, id * 37 % 5000 AS q, lag(id * 37 % 5000 + 1 + id % 30) OVER (PARTITION BY src_port % 10 ORDER BY event_start_time, id) AS e FROM flows) SELECT source_ip, sum(coalesce(((q - e) % 4294967296 + 4294967296) % 4294967296, 0))::BIGINT AS lost, count(*) AS packets FROM p GROUP BY source_ip"),
    "metric_history": (lambda s, d: metrics.history(samples(s, d), "10 minutes"), _WITH + "SELECT time_bucket(INTERVAL '10 minutes', ts) AS bucket, metric_name, labels, max(value) - min(value) AS delta, sum(value)::DOUBLE / count(value) AS value FROM samples GROUP BY ALL"),
    "metric_rollup": (_rollup, _ROLLUP_SQL),
    "metric_drain_counter": (lambda s, d: metrics.drain(samples(s, d), "1 hour", order=("ts", "event_id"), counter=True).select("bucket", "metric_name", "labels", "count", "sum", "first", "last", "delta"),
        _WITH + ", b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, metric_name, labels, count(value) AS count, sum(value)::BIGINT AS sum FROM samples GROUP BY ALL) SELECT *, last - sum AS first, sum AS delta FROM (SELECT *, (sum(sum) OVER (PARTITION BY metric_name, labels ORDER BY bucket))::BIGINT AS last FROM b)"),
    "metric_tier_1h": (lambda s, d: metrics.aggregate_tier(metrics.drain(samples(s, d), order=("ts", "event_id")), "1 hour"),
        _WITH + "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, metric_name, labels, count(*) AS sample_count, count(*) AS count, sum(value)::BIGINT AS sum, sum(d)::BIGINT AS delta, min(value) AS min, max(value) AS max, first(value ORDER BY ts, event_id) AS first, last(value ORDER BY ts, event_id) AS last, sum(value)::DOUBLE / count(*) AS avg, NULL::DOUBLE AS p90, NULL::DOUBLE AS p95, NULL::DOUBLE AS p99 FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY time_bucket(INTERVAL '5 seconds', ts), metric_name, labels ORDER BY ts, event_id) = 1 THEN last_value(value) OVER (PARTITION BY time_bucket(INTERVAL '5 seconds', ts), metric_name, labels ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - value ELSE 0 END AS d FROM samples) GROUP BY ALL"),
    "histogram_percentile": (lambda s, d: metrics.percentiles(metrics.histogram(samples(s, d), "1 hour"), ("metric_name", "labels")), _WITH + f"SELECT metric_name, labels, quantile_disc({_bounds_case('value')}, 0.9) AS p90, quantile_disc({_bounds_case('value')}, 0.95) AS p95, quantile_disc({_bounds_case('value')}, 0.99) AS p99 FROM samples GROUP BY ALL"),
    "histogram_tier": (lambda s, d: metrics.widen_histogram(metrics.histogram(samples(s, d), "5 seconds"), "1 hour"), _WITH + f"SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, metric_name, labels, ({' + '.join(f'(value > {b})::INT' for b in metrics.BOUNDS)})::INT AS bucket_index, CASE WHEN value <= {metrics.BOUNDS[-1]} THEN {_bounds_case('value')} END AS bucket_upper_bound, count(*) AS count FROM samples GROUP BY ALL"),
    "nearest_rank_p95": (_p95, _WITH + "SELECT metric_name, quantile_disc(value, 0.95) AS value FROM (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY ts DESC, event_id DESC) AS r FROM samples) WHERE r <= 1000 GROUP BY metric_name"),
    "counter_delta": (lambda s, d: metrics.clamped_delta(samples(s, d), order=("ts", "event_id")).groupBy("metric_name", "labels").agg(F.sum("delta").alias("gained")), _WITH + "SELECT metric_name, labels, sum(g)::BIGINT AS gained FROM (SELECT *, greatest(0, coalesce(value - lag(value) OVER (PARTITION BY metric_name, labels ORDER BY ts, event_id), 0)) AS g FROM samples) GROUP BY ALL"),
    "gap_fill": (lambda s, d: metrics.fill_gaps(_hourly(s, d), *_DAY, 3600, series=("metric_name",)), _WITH + "SELECT b AS bucket, n.metric_name, coalesce(v, 0) AS value FROM (SELECT DISTINCT metric_name FROM samples) n CROSS JOIN generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-01-06', INTERVAL '1 hour') g(b) LEFT JOIN (SELECT time_bucket(INTERVAL '1 hour', ts) AS h, metric_name, sum(value)::BIGINT AS v FROM samples GROUP BY ALL) s ON s.h = g.b AND s.metric_name = n.metric_name"),
    "pivot_series": (lambda s, d: metrics.pivot(_hourly(s, d), ["click", "error", "signup"]), _WITH + "SELECT *, click + error + signup AS total FROM (SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, coalesce(sum(value) FILTER (metric_name = 'click'), 0)::BIGINT AS click, coalesce(sum(value) FILTER (metric_name = 'error'), 0)::BIGINT AS error, coalesce(sum(value) FILTER (metric_name = 'signup'), 0)::BIGINT AS signup FROM samples GROUP BY 1)"),
    "log_search": (_logs, f"SELECT ts AS timestamp, event_type AS level, props AS message, '{{}}' AS attributes, event_id FROM events WHERE {_between(WEEK, 'ts')} AND event_type = 'click' AND props ILIKE '%\"K\": 1%' ORDER BY ts DESC, event_id LIMIT 200"),
    "log_merge": (lambda s, d: logs.merge(*[_events(s, d).where(F.col("event_type") == t).select("event_id", "event_type") for t in ("click", "error", "click")]), "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')"),
    "series_health": (lambda s, d: metrics.health(samples(s, d).select("labels", F.when(F.col("metric_name") == "error", "fail").otherwise("ok").alias("status")), ("labels",)), _WITH + "SELECT labels, CASE WHEN count(*) FILTER (metric_name = 'error') = 0 THEN 'ok' WHEN count(*) FILTER (metric_name <> 'error') = 0 THEN 'fail' ELSE 'degraded' END AS status, count(*) AS components FROM samples GROUP BY labels"),
    "metric_upsert": (lambda s, d: metrics.latest(samples(s, d), ("metric_name", "labels"), ("ts", "event_id")), _WITH + "SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY metric_name, labels ORDER BY ts DESC, event_id DESC) = 1"),
    "search_projection": (_projection, _WITH + f"SELECT id, 'flow.v1' AS schema_version, 'k' || id AS idempotency_key, 'r' || id AS raw_event_id, source_type, 'main' AS collector_id, 'h' || id % 3 AS source_host, NULL AS source_ip, event_start_time, CASE WHEN id % 4 > 0 THEN event_start_time + INTERVAL 5 SECOND END AS event_end_time, 5 AS duration_ms, {_SQL_IP.format('src_ip_key')} AS src_ip, {_SQL_IP.format('dst_ip_key')} AS dst_ip, src_port, dst_port, transport_protocol, protocol_number, bytes, packets, 'outbound' AS direction, 'dns' AS application_protocol, 'ok' AS normalization_status, '{{}}' AS attributes FROM flows WHERE {_between(WEEK)} ORDER BY event_start_time DESC, id DESC LIMIT 101"),
    "sort_rows": (_sorted, f"SELECT row_number() OVER (ORDER BY coalesce(bytes, 0) DESC) AS place, coalesce(bytes, 0) AS bytes FROM ({_search_sql()})"),
    "tuple_identity": (lambda s, d: _wide(s, d).select("id", fn.tuple_identity().alias("identity")), _WITH + f"SELECT id, 'tuple:' || sha256(concat_ws('|', {_SQL_TIME.format('event_start_time')}, {_SQL_IP.format('src_ip_key')}, {_SQL_IP.format('dst_ip_key')}, protocol_number::VARCHAR)) AS identity FROM flows"),
    "uuid7": (_uuid, _WITH + ", h AS (SELECT id, lpad(printf('%x', epoch_us(event_start_time) // 1000), 12, '0') AS t, sha256('s' || id) AS x FROM flows) SELECT id, t[1:8] || '-' || t[9:12] || '-7' || x[1:3] || '-' || '89ab'[('0x' || x[4])::INT % 4 + 1] || x[5:7] || '-' || x[8:19] AS uuid, true AS valid, false AS other FROM h"),
    "mask_attributes": (_masks, _WITH + """SELECT id, '{"in":[{"session":"***MASKED***"},{"safe_token":"***MASKED***"}],"n":' || id || ',"safe":"b","x-api-key":"***MASKED***"}' AS masked, id % 5 IN (0, 1, 3) AS sensitive FROM flows"""),
    "labels": (_labels, _WITH + r"""SELECT id, '{"a":"\\","b":"x\"' || id || '"}' AS key, 'a="\\",b="x\"' || id || '"' AS text FROM flows"""),
    "protocol_number": (lambda s, d: flows(s, d).select("id", fn.protocol_number(F.col("transport_protocol")).cast("int").alias("number"), fn.transport(F.concat(F.lit(" "), F.upper("transport_protocol"))).alias("name")), _WITH + "SELECT id, CASE transport_protocol WHEN 'icmp' THEN 1 WHEN 'udp' THEN 17 ELSE 6 END AS number, transport_protocol AS name FROM flows"),
    "exposition": (_exposition, _WITH + r"""SELECT metric_name, labels::VARCHAR AS user, 'a"\b' AS q, count(*) AS lines, sum(value)::BIGINT AS total FROM samples WHERE value IS NOT NULL GROUP BY ALL"""),
    "exporter_restarts": (_restarts, _WITH + ", p AS (SELECT src_port % 10 AS source_ip, id * 37 % 5000 - lag(id * 37 % 5000) OVER w AS q, id * 91 % 7000 - lag(id * 91 % 7000) OVER w AS u FROM flows WINDOW w AS (PARTITION BY src_port % 10 ORDER BY event_start_time, id)) SELECT source_ip, count(*) FILTER (q < 0 AND u < 0) AS restarts FROM p GROUP BY source_ip"),
    "packet_router": (_route, _WITH + "SELECT CASE WHEN id % 50 = 0 THEN 'unknown' WHEN id % 12 = 5 THEN 'netflow_v5' WHEN id % 12 = 9 THEN 'netflow_v9' ELSE 'unknown' END AS kind, count(*) AS packets FROM flows GROUP BY ALL"),
    "zeek_batch": (_zeek_batch, _WITH + "SELECT id, i AS record_index, CASE WHEN i < 2 THEN src_port END AS src_port, CASE WHEN i < 2 THEN 'C' || id END AS uid, CASE WHEN i >= 2 THEN 'invalid_zeek_conn' END AS error FROM flows, range(4) r(i)"),
    "proxy_batch": (_proxy, _PROXY_SQL),
    "envelope_validate": (_envelopes, _ENVELOPES_SQL),
    "tier_partial_talkers_1h": (_partial_tier("talkers", "1h"), _tier_sql("1h", fl.TALKERS)),
    "tier_partial_ports_5m": (_partial_tier("ports", "5m"), _tier_sql("5m", fl.PORTS)),
    "v9_decode": (_netflow9, _NETFLOW9_SQL),
    "v9_sampling": (_v9_sampling, _V9_SAMPLING_SQL),
    "metric_query": (_metric_query, _METRIC_QUERY_SQL),
    "history_range": (lambda s, d: _placed(metrics.history_of(samples(s, d), "24h", _t(6))), _WITH + "SELECT row_number() OVER (ORDER BY bucket, metric_name, labels) AS place, * FROM (SELECT time_bucket(INTERVAL '20 minutes', ts) AS bucket, metric_name, labels, max(value) - min(value) AS delta, sum(value)::DOUBLE / count(value) AS value FROM samples WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY ALL)"),
    "metric_latency": (lambda s, d: metrics.latency(_chart(s, d).withColumn("bucket", F.date_trunc("hour", "bucket").cast("timestamp_ntz")).groupBy("bucket", "metric_name", F.col("user").alias("labels")).agg(F.sum("delta").alias("delta"), F.sum("last").alias("value")), "flow_records_stored_total", "flow_records_failed_total"),
        f"""WITH p AS ({_POINTS_SQL}), g AS (SELECT date_trunc('hour', bucket)::TIMESTAMP AS bucket, metric_name, user, sum(delta) AS delta, sum(last) AS value FROM p GROUP BY ALL)
SELECT bucket, user AS labels, coalesce(t / nullif(n, 0), tv / nullif(nv, 0), 0.0) AS latency FROM (SELECT bucket, user, {", ".join(f"(sum(greatest(0, {c})) FILTER (metric_name = '{m}'))::DOUBLE AS {name}" for c, m, name in (("delta", "flow_records_stored_total", "t"), ("delta", "flow_records_failed_total", "n"), ("value", "flow_records_stored_total", "tv"), ("value", "flow_records_failed_total", "nv")))} FROM g GROUP BY ALL)
WHERE t IS NOT NULL AND n IS NOT NULL"""),
    "metric_unpivot": (lambda s, d: metrics.unpivot(_chart(s, d), ["p90", "p95", "p99"], ("id",)), f"WITH p AS ({_POINTS_SQL}) SELECT * FROM (SELECT id, unnest(['p90', 'p95', 'p99']) AS statistic, unnest([p90, p95, p99]) AS value FROM p) WHERE value IS NOT NULL"),
    "metric_window_summary": (lambda s, d: metrics.summary(_chart(s, d).groupBy("metric_name", "user").agg(F.sum("delta").alias("delta"), F.sum("count").alias("count"), F.avg("last").alias("avg"), F.max("last").alias("max")).withColumnRenamed("user", "labels")),
        f"WITH p AS ({_POINTS_SQL}), g AS (SELECT metric_name, user AS labels, sum(delta) AS delta, sum(count) AS count, avg(last) AS avg, max(last) AS max FROM p GROUP BY ALL) SELECT metric_name, labels, greatest(0, delta)::BIGINT AS gained, count::BIGINT AS samples, CASE WHEN count > 0 THEN round(avg * count / count, 3) END AS mean, max AS peak FROM g"),
    "dashboard_series": (lambda s, d: dashboard.series(_chart(s, d), 10), _SERIES_SQL),
    "dashboard_summary": (lambda s, d: dashboard.summary(_chart(s, d), *WEEK), _SUMMARY_SQL),
    "dashboard_live": (lambda s, d: dashboard.live(_chart(s, d).select("metric_name", F.col("last").alias("value")), _chart(s, d)), _LIVE_SQL),
}


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
