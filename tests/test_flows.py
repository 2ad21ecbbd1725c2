import itertools
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow.functions import flow as fn
from weirflow.functions.net import address, bounds, direction, in_network, version
from weirflow.operators import cursor
from weirflow.operators.flows import Filters, QueryError, Tables, TopK, after, first_wins, page, search, tier, top
from weirflow.plans.router import bucket_seconds, flow_tier, metric_tier

T = datetime(2026, 6, 18, 5)


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_addresses(spark):
    rows = [("192.168.1.10",), ("2001:DB8::1",), ("::ffff:10.0.0.1",), ("10.0.0.256",), ("",), (None,)]
    got = values(spark, rows, "ip string", address("ip")["text"], version(address("ip")["key"]), in_network(address("ip")["key"], "192.168.1.77/16"), in_network(address("ip")["key"], "::/0"))
    assert [g[1] for g in got] == [4, 6, 4, None, None, None] and got[0][0] == "192.168.1.10" and got[1][0] == "2001:db8::1"
    assert [g[2] for g in got[:3]] == [True, False, False] and [g[3] for g in got[:3]] == [False, True, True]
    assert bounds("10.1.2.3/8", True) == (167772160, 184549375)


@pytest.mark.parametrize(("src", "dst", "want"), [("192.168.1.10", "10.0.0.5", "internal"), ("192.168.1.10", "8.8.8.8", "outbound"), ("8.8.8.8", "172.16.0.1", "inbound"), ("1.1.1.1", "8.8.8.8", "external"), ("x", "8.8.8.8", "unknown"), ("fd00::1", "10.0.0.1", "inbound")])
def test_direction(spark, src, dst, want):
    assert values(spark, [(src, dst)], "s string, d string", direction(address("s")["key"], address("d")["key"])) == [(want,)]


def test_scalars(spark):
    numbers = [(n,) for n in (0, 6, 17, 1, 132)]
    assert [r[0] for r in values(spark, numbers, "n int", fn.protocol_name(F.col("n")))] == ["unknown", "tcp", "udp", "icmp", "unknown"]
    keys = ["token", "db_password", "X-Api-Key", "sessionid", "safe", "authorization", "count"]
    assert [r[0] for r in values(spark, [(k,) for k in keys], "k string", fn.sensitive(F.col("k")))] == [True, True, True, False, False, True, False]
    text = '{"token":1,"nested":{"authorization":"a","safe":2},"safe_array":[{"cookie":"c"},{"count":3}]}'
    want = '{"nested":{"authorization":"***MASKED***","safe":2},"safe_array":[{"cookie":"***MASKED***"},{"count":3}],"token":"***MASKED***"}'
    assert values(spark, [(text,), ("[1]",), (None,), ("bad",)], "j string", fn.mask_json("j")) == [(want,), ("{}",), ("{}",), ("{}",)]
    times = [datetime(2026, 1, 1, 0, 0, 10), datetime(2026, 1, 1, 0, 0, 0, 120000), datetime(2026, 1, 1, 0, 0, 0, 1)]
    assert [r[0][17:] for r in values(spark, [(t,) for t in times], "t timestamp", fn.rfc3339(F.col("t")))] == ["10Z", "00.12Z", "00.000001Z"]
    ids = values(spark, [(T, "a"), (T, "a"), (T, "b")], "t timestamp, s string", fn.uuid7(F.col("t"), F.col("s")), fn.is_uuid7(fn.uuid7(F.col("t"), F.col("s"))))
    assert ids[0] == ids[1] != ids[2] and all(ok for _, ok in ids)
    assert values(spark, [({"b": 'x"', "a": "1"},)], "m map<string,string>", fn.labels_key(F.col("m")), fn.labels_text(F.col("m"))) == [('{"a":"1","b":"x\\""}', 'a="1",b="x\\""')]


def test_routing():
    assert flow_tier(timedelta(hours=6), "talkers") == "5m" and flow_tier(timedelta(hours=6, microseconds=1), "talkers") == "1h"
    assert flow_tier(timedelta(hours=2), "ports", by_address=True) == "raw"
    assert [metric_tier(timedelta(hours=h)) for h in (6, 7, 168, 169)] == ["base", "5m", "5m", "1h"]
    assert bucket_seconds(timedelta(minutes=7)) == 5 and bucket_seconds(timedelta(days=1)) == 3600


@pytest.mark.parametrize(("options", "code"), [({"end": T}, "invalid_parameter"), ({"end": T + timedelta(days=8)}, "query_window_too_large"), ({"src_ip": "1.1.1.1", "src_cidr": "1.0.0.0/8"}, "invalid_parameter"), ({"dst_port": 1, "dst_ports": (1, 2)}, "invalid_parameter"), ({"dst_ports": (3, 2)}, "invalid_parameter"), ({"protocol_number": 17, "transport_protocol": "tcp"}, "invalid_parameter")])
def test_query_errors(options, code):
    with pytest.raises(QueryError) as e:
        Filters(**{"start": T, "end": T + timedelta(hours=1)} | options).check()
    assert e.value.args[0] == code


def fixture(spark):
    rows = [("1", "rest_json", T, "192.168.1.10", "8.8.8.8", 12345, 80, 6, "tcp", 500, 5, "outbound"), ("2", "netflow_v5", T + timedelta(seconds=10), "10.0.0.1", "192.168.1.10", 54321, 443, 17, "udp", 1500, 10, "inbound")]
    df = spark.createDataFrame(rows, "id string, source_type string, event_start_time timestamp, s string, d string, src_port int, dst_port int, protocol_number int, transport_protocol string, bytes long, packets long, direction string")
    return df.withColumn("src_ip_key", address("s")["key"]).withColumn("dst_ip_key", address("d")["key"])


def test_search_and_top(spark):
    df = fixture(spark)
    span = {"start": T - timedelta(minutes=10), "end": T + timedelta(minutes=10)}
    ids = lambda **f: [r.id for r in search(df, Filters(**span, **f)).collect()]
    assert ids() == ["2", "1"] and ids(src_ip="10.0.0.1") == ["2"] and ids(src_cidr="10.0.0.0/24") == ["2"]
    assert ids(src_port=12345) == ["1"] and ids(dst_ports=(440, 450)) == ["2"] and ids(direction="outbound") == ["1"]
    got = top(Tables(df), TopK(Filters(**span), ("src_port",), which="raw")).collect()
    assert [(r.src_port, r.value) for r in got] == [(54321, 1500), (12345, 500)]
    got = top(Tables(df, {("talkers", "5m"): tier(df, "5m")}), TopK(Filters(T - timedelta(hours=1), T + timedelta(hours=1)), ("protocol_number", "transport_protocol"), "packets")).collect()
    assert [(r.protocol_number, r.value) for r in got] == [(17, 10), (6, 5)]


@pytest.mark.parametrize("limit", [1, 3, 7])
def test_pages_make_the_whole(spark, limit):
    rows = [(T + timedelta(seconds=i % 4), f"{i:02d}") for i in range(20)]
    df = spark.createDataFrame(rows, "event_start_time timestamp, id string")
    span, seen, at = Filters(T, T + timedelta(hours=1)), [], None
    while True:
        found, at = page(search(df, span, limit, at), limit)
        seen += [(r.event_start_time, r.id) for r in found]
        if at is None:
            break
    assert seen == sorted(rows, reverse=True)


def test_null_counters_by_path(spark):
    """Raw rows without bytes don't count; in a tier they do, beside rows that have them."""
    rows = [("1", T, 1, 10), ("1", T, 1, None), ("2", T, 2, None)]
    df = spark.createDataFrame(rows, "id string, event_start_time timestamp, src_port int, bytes long").withColumn("packets", F.lit(1))
    run = lambda which: [tuple(r) for r in top(Tables(df), TopK(Filters(T, T + timedelta(hours=1)), ("src_port",), which=which)).collect()]
    assert run("raw") == [(1, 10, 1)] and run("5m") == [(1, 10, 2)]


def test_cursor():
    key, values_ = b"secret", (T, "a", 3, b"\x0a\x00\x00\x01")
    token = cursor.encode(values_, key, "q")
    assert cursor.decode(token, key, "q") == (T, "a", 3, bytearray(b"\x0a\x00\x00\x01"))
    for bad in (token[:-2] + "AA", "x", token + ".y"):
        with pytest.raises(QueryError):
            cursor.decode(bad, key, "q")
    with pytest.raises(QueryError):
        cursor.decode(token, key, "other")


def test_after_and_first_wins(spark):
    rows = list(itertools.product((1, 2), (1, 2), (1, 2)))
    df = spark.createDataFrame(rows, "a int, b int, c int")
    got = {tuple(r) for r in df.where(after([("a", True), ("b", True), ("c", False)], (2, 1, 1))).collect()}
    assert got == {(2, 1, 2), (1, 1, 1), (1, 1, 2), (1, 2, 1), (1, 2, 2)}
    kept = first_wins(spark.createDataFrame([("k", 2, "x"), ("k", 1, "y"), ("l", 3, "z")], "k string, n int, v string"), ("k",), ("n",))
    assert sorted(tuple(r) for r in kept.collect()) == [("k", 1, "y"), ("l", 3, "z")]
