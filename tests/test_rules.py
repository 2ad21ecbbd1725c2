"""Rules of queries, sinks and streams that no SQL expresses."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_sources import DATA, TEMPLATE, v9
from weirflow.operators import metrics, store
from weirflow.operators.flows import Filters, Tables, TopK, top
from weirflow.functions import net
from weirflow.sources import datagrams, netflow5, netflow9, rest, zeek

T = datetime(2026, 6, 18, 5)
KEYS = "collector_id string, source_host string, source_ip string, source_id long, packet binary, received_at timestamp, arrival long"


@pytest.mark.parametrize(("options", "code"), [({"end": T}, "invalid_parameter"), ({"step": 3}, "invalid_parameter"), ({"step": 7}, "invalid_parameter"), ({"end": T + timedelta(seconds=5001)}, "query_window_too_large")])
def test_metric_query_rules(options, code):
    with pytest.raises(metrics.MetricError) as e:
        metrics.MetricQuery(**{"start": T, "end": T + timedelta(minutes=5)} | options).check()
    assert e.value.args[0] == code
    assert metrics.MetricQuery(T, T + timedelta(seconds=5000)).check() == 5 and metrics.MetricQuery(T, T + timedelta(days=1), 300).check() == 300


def test_waiting_flowsets_keep_their_numbers():
    state = netflow9.Exporter()
    assert list(state.fold(v9(DATA, DATA, seq=9), 0.0)) == []
    got = list(state.fold(v9(TEMPLATE, DATA, seq=10), 1.0))
    places = [(g[0][0], g[1]) for g in got]
    assert len(set(places)) == 3 and [p[0] for p in places] == [9, 9, 10]


def test_longest_known_template_goes_first(monkeypatch):
    """By when templates last came, however much they are used; the signature of one that went stays."""
    monkeypatch.setattr(netflow9, "MOST_TEMPLATES", 2)
    state = netflow9.Exporter()
    learn = lambda tid, fields, now: list(state.learn(netflow9.Template(0, tid, tuple(fields)), now))
    learn(256, [(8, 4)], 0.0)
    learn(257, [(8, 4)], 1.0)
    learn(256, [(8, 4)], 2.0)
    learn(258, [(8, 4)], 3.0)
    assert set(state.known) == {(0, 256), (0, 258)} and set(state.expired) == {(0, 257)}
    learn(256, [(12, 4)], 4.0)
    learn(257, [(8, 4)], 5.0)
    assert {k[1]: g for k, (_, _, g) in state.known.items()} == {256: 2, 257: 2}


def test_batch_waits_as_a_stream_does(spark):
    row = lambda p, s, n: ("main", "h", "10.0.0.1", 7, bytearray(p), T + timedelta(seconds=s), n)
    rows = [row(v9(DATA, DATA, seq=1), 0, 1), row(v9(TEMPLATE, seq=2), 20, 2), row(v9(DATA, seq=3), 21, 3), row(b"\0\1", 22, 4), row(v9((300, b"abcd"), seq=5), 23, 5), row(v9(seq=6), 60, 6), row(v9((301, b"abcd"), seq=7), 60, 7)]
    got = netflow9.parse(spark.createDataFrame(rows, KEYS)).collect()
    assert sorted((r.packet_sequence, r.record_index) for r in got if not r.error) == [(1, 0), (1, len(DATA[1])), (3, 0)]
    assert sorted((r.packet_sequence or 0, r.error) for r in got if r.error) == [(0, "malformed_packet"), (5, "pending_expired")]


def test_timeouts_come_out():
    state = netflow9.Exporter()
    list(state.fold(v9(DATA, seq=4), 100.0))
    got = netflow9.timed_out(state, ("c", "h", "i", 7), state.deadline())
    assert list(got["error"]) == ["pending_expired"] and list(got["packet_sequence"]) == [4] and not state.waiting


def test_times_and_fields_are_strict(spark):
    record = '{{"event_start_time":"{}","src_ip":"{}","dst_ip":"8.8.8.8","src_port":1,"dst_port":2,"transport_protocol":"tcp"{}}}'
    rows = [record.format(*x) for x in (("2026-06-16T10:15:20Z", "1.1.1.1", ""), ("2026-06-16", "1.1.1.1", ""), ("2026-06-16 10:15:20", "1.1.1.1", ""), ("2026-06-16T10:15:20.5+02:00", " 1.1.1.1 ", ""), ("2026-06-16T10:15:20Z", "1.1.1.1", ',"new":1'))]
    got = [r[0] for r in rest.parse(spark.createDataFrame([(x,) for x in rows], "value string")).select(rest.error()).collect()]
    assert got == [None, "invalid_event_start_time", "invalid_event_start_time", "invalid_src_ip", "invalid_record"]
    requests = spark.createDataFrame([('{"records":[' + rows[4] + "]}",)], "value string")
    assert [r.rest for r in rest.explode(requests).collect()] == [None]


def test_columns_of_others_stay(spark):
    lines = spark.createDataFrame([('{"ts":1}', 5)], "value string, _raw int")
    assert zeek.parse(lines).select("_raw").first()[0] == 5
    packets = spark.createDataFrame([(bytearray(b"x"), 5, 6)], "packet binary, _i int, _body int")
    assert netflow5.parse(packets)[1].select("_i", "_body").first() == (5, 6)


def test_zeek_lines_are_bounded(spark):
    got = zeek.bounded(spark.createDataFrame([("x" * 10,), (" ",), ("y",)], "value string"), most=5).collect()
    assert [(r.value[0], r.line_error) for r in got] == [("x", "line_too_long"), ("y", None)]


def test_captured_datagrams(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.bin").write_bytes(b"\0\5rest")
    (tmp_path / "2.bin").write_bytes(b"\0\t" + b"z" * 2000)
    got = sorted((bytes(r.packet)[1], len(r.packet), r.cut) for r in datagrams.read(spark, str(tmp_path)).collect())
    assert got == [(5, 6, False), (9, 1500, True)]
    query = datagrams.stream(spark, str(tmp_path / "*")).writeStream.format("memory").queryName("datagrams").trigger(availableNow=True).start()
    assert query.awaitTermination(60) and spark.table("datagrams").count() == 2


def test_tiers_read_their_times_only(spark, tmp_path):
    path = str(tmp_path / "flows")
    rows = [(f"{i}", T + timedelta(hours=i), 1, 10) for i in range(48)]
    df = spark.createDataFrame(rows, "id string, event_start_time timestamp, src_port int, bytes long").withColumn("packets", F.lit(1))
    df.withColumn("event_date", F.to_date("event_start_time")).write.partitionBy("event_date").parquet(path)
    found = top(Tables(spark.read.parquet(path)), TopK(Filters(T + timedelta(minutes=30), T + timedelta(hours=8)), ("src_port",), "flows"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(event_start_time" in pushed and "LessThan(event_start_time" in pushed and "event_date" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    assert [tuple(r) for r in found.collect()] == [(1, 7, 7)]


def test_sinks(spark, tmp_path):
    path = lambda name: str(tmp_path / name)
    points = lambda *v: spark.createDataFrame([(T + timedelta(days=d), "m", n, x) for d, n, x in v], "bucket timestamp, metric_name string, written int, value long")
    store.upsert(points((0, 1, 1), (1, 1, 2)), path("m"), ("bucket", "metric_name"), ("written",))
    store.upsert(points((1, 2, 5), (2, 2, 6)), path("m"), ("bucket", "metric_name"), ("written",))
    store.upsert(points((1, 1, 4)), path("m"), ("bucket", "metric_name"), ("written",))  # older than what is there
    assert [r.value for r in store.read(spark, path("m")).orderBy("bucket").collect()] == [1, 5, 6]
    state = lambda key, value, at: spark.createDataFrame([(key, "c", "rest_json", "h", value, at)], store.STATE)
    assert store.load_state(spark, path("s"), "k").count() == 0
    for at, value in enumerate(("a", "b")):
        store.save_state(state("k", value, T + timedelta(seconds=at)), path("s"))
    store.save_state(state("l", "c", T), path("s"))
    assert store.load_state(spark, path("s"), "k").first().state == "b" and store.load_state(spark, path("s")).count() == 2
    with pytest.raises(ValueError, match="required"):
        store.load_state(spark, path("s"), " ")
    store.append_logs(spark.createDataFrame([(T, "INFO", "x", {"a": "1"}), (T, "INFO", "y", None)], "timestamp timestamp, level string, message string, attributes map<string,string>"), path("l"))
    assert sorted(r.attributes for r in store.read(spark, path("l")).collect()) == ['{"a":"1"}', "{}"]
    store.append_snapshots(spark.createDataFrame([(T + timedelta(days=i), "m", i) for i in range(3)], "ts timestamp, metric_name string, value long"), path("p"))
    assert store.expire(spark, path("p"), T + timedelta(days=3), 2) == ["event_date=2026-06-18"] and store.read(spark, path("p")).count() == 2


def test_refresh_is_due():
    assert store.due("5m", None, T) == [date(2026, 6, 17), date(2026, 6, 18)]
    assert store.due("5m", T - timedelta(seconds=59), T) == [] and len(store.due("1h", T - timedelta(minutes=5), T)) == 8


def test_ipv6_texts(spark):
    import ipaddress

    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "2001:DB8::10", ":::1::", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "12345::", "g::", "::1.2.3.256", "1.2.3.4", "::1.2.3", ":1", "1:", "", "::1%eth0", "1:2:3:4:5:6:7:1.2.3.4", "::01.2.3.4"]

    def sound(text):
        try:
            return ":" in text and "%" not in text and bool(ipaddress.IPv6Address(text))
        except ValueError:
            return False

    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", net.is_ipv6(F.col("t")).alias("is")).collect()
    assert {r.t: r["is"] for r in got} == {t: sound(t) for t in texts} | {None: False}


def test_mapped_addresses(spark):
    rows = spark.createDataFrame([("::ffff:1.2.3.4",), ("1.2.3.4",), ("::1",), ("x",)], "t string").withColumn("a", net.address("t")).select("t", net.unmapped(F.col("a")).alias("a")).collect()
    assert [(r.a.text, r.a.key and bytes(r.a.key)) for r in rows] == [("1.2.3.4", b"\1\2\3\4"), ("1.2.3.4", b"\1\2\3\4"), ("::1", bytes(15) + b"\1"), (None, None)]


def test_rates_and_latency_rules(spark):
    base = [(T, "c", "x", 5.0, "counter"), (T, "g", "x", 5.0, "gauge"), (T, "h", "x", 5.0, "counter")]
    df = spark.createDataFrame(base, "bucket timestamp, metric_name string, labels string, delta double, metric_kind string").withColumns({c: F.lit(1.0) for c in ("sample_count", "count", "sum", "min", "max", "first", "last")})
    histogram = spark.createDataFrame([(T, "h", "x", 3, 10.0, 4)], "bucket timestamp, metric_name string, labels string, bucket_index int, bucket_upper_bound double, count long")
    got = {r.metric_name: (r.rate_avg, r.rate_peak, r.p90) for r in metrics.rollup(df, histogram, T, T + timedelta(hours=1), 5).collect()}
    assert got == {"c": (1.0, 1.0, None), "g": (None, None, None), "h": (None, None, 10.0)}  # a point with a histogram has no rates
    pairs = spark.createDataFrame([(1, "t", "x", 0, 90.0), (1, "n", "x", 0, 30.0), (2, "t", "x", 5, 1.0), (2, "n", "x", -1, 0.0), (3, "t", "x", 8, 0.0), (3, "n", "x", 2, 1.0)], "bucket int, metric_name string, labels string, delta long, value double")
    assert {r.bucket: r.latency for r in metrics.latency(pairs, "t", "n").collect()} == {1: 3.0, 2: 0.0, 3: 4.0}


def test_window_reaches_the_scan(spark, tmp_path):
    from weirflow import queries

    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    for name in ("metric_rollup", "metric_query"):
        plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.split("PushedFilters")[1:]]
        assert scans and all("GreaterThanOrEqual(ts" in x[:300] and "LessThan(ts" in x[:300] for x in scans), name


def test_equal_attributes_are_masked_once(monkeypatch):
    """A batch parses each distinct text once; nulls, blanks and broken texts keep their places."""
    import json

    import pandas as pd

    from weirflow.functions import flow

    parsed = []
    loads = json.loads
    monkeypatch.setattr(flow.json, "loads", lambda text: parsed.append(text) or loads(text))
    texts = ['{"token":"x","n":1}', None, "bad", '{"token":"x","n":1}', "", "[1]", "bad", None]
    masked = '{"n":1,"token":"***MASKED***"}'
    assert flow.mask_json.func(pd.Series(texts)).tolist() == [masked, "{}", "{}", masked, "{}", "{}", "{}", "{}"]
    assert sorted(parsed) == sorted(['{"token":"x","n":1}', "bad", "[1]"])
    assert flow.mask_json.func(pd.Series([None, None], dtype=object)).tolist() == ["{}", "{}"] and flow.mask_json.func(pd.Series([], dtype=object)).tolist() == []
