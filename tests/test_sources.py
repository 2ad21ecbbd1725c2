import random
import struct
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from weirflow.operators import metrics, normalize
from weirflow.sources import netflow5, netflow9, rest, zeek

ENVELOPE = ("01934d7c-79b4-7000-8b69-001122334455", "main", "host", "203.0.113.10", datetime(2026, 6, 16, 10, 15, 19))
NAMES = "event_id string, collector_id string, source_host string, source_ip string, received_at timestamp"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def rest_flow(spark, **changes):
    record = {"external_id": "client-flow-0001", "event_start_time": "2026-06-16T10:15:20Z", "event_end_time": "2026-06-16T10:15:25Z", "src_ip": "192.168.1.10", "dst_ip": "8.8.8.8", "src_port": 51524, "dst_port": 53, "transport_protocol": "UDP", "protocol_number": 17, "bytes": 420, "packets": 3, "application_protocol": "dns", "attributes": {"token": "secret", "integration": "demo"}} | changes
    import json

    df = spark.createDataFrame([(*ENVELOPE, json.dumps({k: v for k, v in record.items() if v is not None}))], NAMES + ", value string").withColumn("source_type", F.lit("rest_json"))
    return one(normalize.rest(rest.parse(df)))


def test_rest(spark):
    r = rest_flow(spark)
    assert (r.error, r.direction, r.transport_protocol, r.protocol_number, r.bytes, r.packets, r.duration_ms, r.normalization_status) == (None, "outbound", "udp", 17, 420, 3, 5000, "ok")
    assert r.attributes == '{"integration":"demo","token":"***MASKED***"}' and r.idempotency_key == rest_flow(spark).idempotency_key
    assert r.idempotency_key != rest_flow(spark, dst_ip="1.1.1.1").idempotency_key
    assert rest_flow(spark, external_id=None).idempotency_key == rest_flow(spark, external_id=None).idempotency_key
    bad = {"invalid_src_ip": {"src_ip": "invalid-ip-address"}, "invalid_src_port": {"src_port": 999999}, "invalid_transport_protocol": {"transport_protocol": "x"}, "invalid_event_start_time": {"event_start_time": "x"}, "invalid_event_end_time": {"event_end_time": "2026-06-16T10:15:19Z"}}
    for code, change in bad.items():
        assert rest_flow(spark, **change).error == code
    assert rest_flow(spark, transport_protocol="tcp").error is None


def test_rest_requests(spark):
    good = '{"records":[{"src_ip":"1.1.1.1","src_port":1},{"src_ip":"2.2.2.2"}]}'
    got = rest.explode(spark.createDataFrame([(good,), ("{bad",)], "value string")).collect()
    assert {(r.record_index, r.rest.src_ip if r.rest else None) for r in got} == {(0, "1.1.1.1"), (0, None), (1, "2.2.2.2")}


LINE = '{"ts":1781604920.123,"uid":"CAbCdEf123","id.orig_h":"192.168.1.10","id.orig_p":51524,"id.resp_h":"8.8.8.8","id.resp_p":53,"proto":"udp","service":"dns","duration":0.045,"orig_bytes":60,"resp_bytes":120,"orig_pkts":1,"resp_pkts":1,"conn_state":"SF","history":"Dd","local_orig":true,"api_token":"x"}'


def zeek_flow(spark, line):
    df = spark.createDataFrame([(*ENVELOPE, line)], NAMES + ", value string").withColumn("source_type", F.lit("zeek_conn_json"))
    return one(normalize.zeek(zeek.parse(df)))


def test_zeek(spark):
    r = zeek_flow(spark, LINE)
    assert (r.error, r.bytes, r.packets, r.application_protocol, r.flow_state, r.duration_ms) == (None, 180, 2, "dns", "SF", 45)
    assert r.event_start_time == datetime(2026, 6, 16, 10, 15, 20, 123000) and r.event_end_time == datetime(2026, 6, 16, 10, 15, 20, 168000)
    assert '"api_token":"***MASKED***"' in r.attributes and '"local_orig":"true"' in r.attributes
    r = zeek_flow(spark, LINE.replace('"resp_bytes":120', '"resp_bytes":"-"').replace('"resp_pkts":1,', ""))
    assert (r.bytes, r.packets, r.normalization_status) == (None, None, "partial") and '"bytes_partial":"true"' in r.attributes
    assert zeek_flow(spark, LINE.replace("id.orig_h", "id_orig_h")).src_ip == "192.168.1.10"
    assert zeek_flow(spark, LINE.replace('{"ts"', '{"id_orig_h":"192.0.2.11","ts"')).error == "conflicting_alias"
    assert zeek_flow(spark, LINE.replace("60,", '"bad",')).error == "invalid_number"
    assert zeek_flow(spark, "{bad-json").error == "invalid_json"
    assert zeek_flow(spark, LINE.replace("1781604920.123", "0")).error == "missing_field"


def test_zeek_types_are_strict(spark):
    """Text isn't a number, and a number isn't text."""
    numbers = [('"ts":1781604920.123', '"ts":"1781604920.123"'), ('"id.orig_p":51524', '"id.orig_p":"51524"'), ("51524", "51524.0"), ("51524", "4294967296"), ("51524", "-1"), ("0.045", '"-"'), ("0.045", "null"), ('"orig_pkts":1', '"orig_pkts":true')]
    missing = [('"proto":"udp"', '"proto":6'), ('"id.orig_h":"192.168.1.10"', '"id.orig_h":5'), ('"ts":1781604920.123,', "")]
    fine = [("true", '"true"'), ('"SF"', "5"), ("60,", "null,"), ("60,", '"-",'), ("0.045", "1e-3")]
    lines = [(i, LINE.replace(*x)) for i, x in enumerate(numbers + missing + fine)]
    got = {r.i: r.zeek for r in zeek.parse(spark.createDataFrame(lines, "i int, value string").coalesce(1)).collect()}
    assert [got[i].error for i in sorted(got)] == ["invalid_number"] * len(numbers) + ["missing_field"] * len(missing) + [None] * len(fine)
    first, second, third, fourth, fifth = (got[len(numbers) + len(missing) + i] for i in range(len(fine)))
    assert first.local_orig is None and second.conn_state is None and third.orig_bytes is None and fourth.orig_bytes is None and fifth.duration == 0.001


def test_zeek_nested_secrets(spark):
    line = LINE[:-1] + ',"x":{"password":"hunter2","deep":[{"db-Secret":"hunter2","n":1}]},"n":5,"list":[1,"a"]}'
    attributes = zeek_flow(spark, line).attributes
    assert "hunter2" not in attributes
    import json

    got = json.loads(attributes)
    assert got["x"] == {"password": "***MASKED***", "deep": [{"db-Secret": "***MASKED***", "n": 1}]} and got["n"] == 5 and got["list"] == [1, "a"]
    extra = one(zeek.parse(spark.createDataFrame([(line,)], "value string"))).zeek.extra
    assert "hunter2" not in extra


def v5(n=2, version=5):
    head = struct.pack(">HHIIIIBBH", version, n, 10000, 1718532920, 125_000_000, 42, 1, 2, 1)
    record = lambda i: bytes([192, 0, 2, 10 + i, 198, 51, 100, 20 + i, 203, 0, 113, 1]) + struct.pack(">HHIIIIHHBBBBHHBBH", 10, 20, 3, 420, 1000, 2000, 51524 + i, 443, 0, 0x12, 6, 0, 64512, 64513, 24, 24, 0)
    return head + b"".join(record(i) for i in range(n))


def test_netflow5(spark):
    packets = [(*ENVELOPE, bytearray(p)) for p in (v5(), v5(version=9), v5()[:-1], b"")]
    df = spark.createDataFrame(packets, NAMES + ", packet binary").withColumn("source_type", F.lit("netflow_v5"))
    good, bad = netflow5.parse(df)
    rows = sorted(good.select("v5.*").collect(), key=lambda r: r.record_index)
    assert [(r.packet_sequence, r.src_addr, r.dst_addr, r.src_port, r.bytes, r.packets, r.tcp_flags, r.sampling_rate, r.src_as) for r in rows] == [(42, f"192.0.2.{10 + i}", f"198.51.100.{20 + i}", 51524 + i, 420, 3, 18, 1, 64512) for i in range(2)]
    assert sorted(r.error for r in bad.collect()) == ["invalid_packet", "invalid_packet", "unsupported_version"]
    flow = normalize.netflow5(good).orderBy("src_ip").first()
    assert flow.error is None and flow.event_start_time == datetime(2024, 6, 16, 10, 15, 11, 125000) and flow.duration_ms == 1000 and flow.next_hop_ip == "203.0.113.1"
    assert [r.kind for r in netflow5.route(df).collect()] == ["netflow_v5", "netflow_v9", "netflow_v5", "unknown"]


def test_gaps_and_restarts(spark):
    rows = [(1, "a", 10, 5, 100, 1), (2, "a", 15, 5, 200, 2), (3, "a", 25, 1, 300, 3), (4, "a", 2**32 - 1, 2, 10, 4), (5, "a", 1, 1, 20, 5)]
    df = spark.createDataFrame(rows, "received_at int, source_ip string, sequence long, records long, uptime_ms long, export_time int")
    assert [r.lost for r in netflow5.gaps(df).orderBy("received_at").collect()] == [0, 0, 5, 2**32 - 27, 0]
    assert [r.restarted for r in netflow5.restarts(df).orderBy("received_at").collect()] == [False, False, False, True, False]


def v9(*sets, seq=1, source=7):
    body = b"".join(struct.pack(">HH", k, len(b) + 4) + b for k, b in sets)
    return struct.pack(">HHIIII", 9, len(sets), 10000, 1781604920, seq, source) + body


FIELDS = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1), (1, 4), (2, 4), (22, 4), (21, 4)]
TEMPLATE = (0, struct.pack(">HH", 256, len(FIELDS)) + b"".join(struct.pack(">HH", *f) for f in FIELDS))
DATA = (256, bytes([192, 168, 1, 10, 8, 8, 8, 8]) + struct.pack(">HHBIIII", 51524, 443, 6, 420, 3, 1000, 2000))


def test_netflow9_state():
    state = netflow9.Exporter()
    assert list(state.fold(v9(DATA, seq=1), 0.0)) == [] and len(state.waiting) == 1
    got = list(state.fold(v9(TEMPLATE, DATA, seq=2), 1.0))
    assert [(g[0][0], g[2], g[3][8], g[3][1], g[4]) for g in got] == [(1, 256, "192.168.1.10", "420", None), (2, 256, "192.168.1.10", "420", None)]
    assert [g[4] for g in state.fold(v9(DATA), 4000.0)] == [] and [g[4] for g in state.fold(v9(), 4040.0)] == ["pending_expired"]
    options = (1, struct.pack(">HHHHHHH", 300, 4, 4, 2, 4, 34, 4))
    list(state.fold(v9(options, (300, struct.pack(">II", 1, 100))), 4041.0))
    assert state.sampling == {"interface": 1, "interval": 100}
    assert [g[4] for g in state.fold(b"\0\1" + v9()[2:], 1.0)] == ["unsupported_version"]


def test_netflow9_never_raises():
    rng = random.Random(2)
    for _ in range(3000):
        state, packet = netflow9.Exporter(), bytearray(v9(TEMPLATE, DATA, (1, b"\1\x2c\0\4\0\4\0\1\0\4\0\x22\0\4")))
        for _ in range(rng.randrange(8)):
            packet[rng.randrange(2, len(packet))] = rng.randrange(256)
        list(state.fold(bytes(packet[: rng.randrange(len(packet) + 1)]), 0.0))


def test_netflow9_flow(spark):
    at = datetime(2026, 6, 16, 10, 15, 20)
    rows = [("main", "host", "10.0.0.1", 7, bytearray(v9(TEMPLATE, seq=1)), at, 1), ("main", "host", "10.0.0.1", 7, bytearray(v9(DATA, DATA, seq=2)), at, 2), ("main", "host", "10.0.0.2", 7, bytearray(v9(DATA)), at, 1)]
    packets = spark.createDataFrame(rows, "collector_id string, source_host string, source_ip string, source_id long, packet binary, received_at timestamp, arrival int")
    decoded = netflow9.parse(packets).withColumn("event_id", F.lit(ENVELOPE[0])).withColumn("source_type", F.lit("netflow_v9"))
    flows = normalize.netflow9(decoded).collect()
    assert len(flows) == 2 and {(f.error, f.bytes, f.packets, f.duration_ms, f.transport_protocol, f.direction) for f in flows} == {(None, 420, 3, 1000, "tcp", "outbound")}
    assert flows[0].event_start_time == datetime.fromtimestamp(1781604920 - 9, timezone.utc).replace(tzinfo=None)


def test_metrics(spark):
    at = datetime(2026, 1, 1)
    rows = [(at, i, "d", "x", v) for i, v in enumerate((1, 2, 5, 10))]
    df = spark.createDataFrame(rows, "ts timestamp, n int, metric_name string, labels string, value long")
    got = one(metrics.drain(df, order=("ts", "n")))
    assert (got["count"], got["sum"], got["min"], got["max"], got["first"], got["last"]) == (4, 18, 1, 10, 1, 10)
    hist = metrics.histogram(df, "5 seconds")
    assert hist.count() == 4 and tuple(one(metrics.percentiles(hist, ("metric_name",))))[1:] == (10.0, 10.0, 10.0)
    counter = one(metrics.drain(spark.createDataFrame([(at, "c", "x", 3), (at, "c", "x", 2)], "ts timestamp, metric_name string, labels string, value long"), counter=True))
    assert (counter["sum"], counter["delta"], counter["first"], counter["last"]) == (5, 5, 0, 5)
    base = spark.createDataFrame([(at, "c", "x", 1, 1, 1.0, 1.0, 1.0, 0.0, 0.0, 30000.0, "counter"), (at + timedelta(seconds=5), "c", "x", 1, 1, 1.0, 1.0, 1.0, 0.0, 0.0, 0.0, "counter")], "bucket timestamp, metric_name string, labels string, sample_count int, count int, sum double, min double, max double, first double, last double, delta double, metric_kind string")
    point = one(metrics.rollup(base, None, at, at.replace(hour=1), 20))
    assert (point.delta, point.rate_avg, point.rate_peak) == (30000.0, 1500.0, 6000.0)
    reset = spark.createDataFrame([(1, "c", "x", 100), (2, "c", "x", 112), (3, "c", "x", 2)], "ts int, metric_name string, labels string, value long")
    assert [r.delta for r in metrics.clamped_delta(reset).orderBy("ts").collect()] == [0, 12, 0]
    pairs = spark.createDataFrame([(1, "t", "x", 600), (1, "n", "x", 20)], "bucket int, metric_name string, labels string, delta long")
    assert one(metrics.latency(pairs, "t", "n")).latency == 30.0
    text = metrics.exposition(spark.createDataFrame([("b", {"k": 'a"\n\\'}, 1.5), ("a", {}, 2.0)], "metric_name string, labels map<string,string>, value double"))
    assert [r.line for r in text.collect()] == ["a 2.0", 'b{k="a\\"\\n\\\\"} 1.5']
    back = {r.metric_name: (r.labels, r.value) for r in metrics.read_exposition(text.withColumnRenamed("line", "value")).collect()}
    assert back == {"a": ({}, 2.0), "b": ({"k": 'a"\n\\'}, 1.5)}


def test_zeek_without_extra_needs_no_python(spark):
    """What a query doesn't ask for isn't computed: masking in Python is for `extra` alone."""
    from weirflow.sources import zeek

    lines = spark.createDataFrame([('{"ts":1.5,"id.orig_h":"10.0.0.1","id.resp_h":"8.8.8.8","proto":"tcp","id.orig_p":5,"site":{"password":"x"}}',)], "value string")
    got = zeek.parse(lines)
    plain = got.select("zeek.id_orig_p", "zeek.error")
    assert "ArrowEvalPython" not in plain._jdf.queryExecution().executedPlan().toString()
    assert tuple(plain.first()) == (5, None)
    assert got.select("zeek.extra").first()[0] == '{"site":{"password":"***MASKED***"}}'
