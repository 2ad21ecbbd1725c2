"""Capture files in stretches and as they grow, and the way of datagrams to their decoders."""

import socket
import struct
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.test_sources import DATA, TEMPLATE, v5, v9
from weirflow.sources import capture

START = int(datetime(2026, 6, 16, 10, tzinfo=timezone.utc).timestamp())


def head(link=capture.RAW, order="<", nanos=False):
    return struct.pack(order + "IHHiIII", 0xA1B23C4D if nanos else 0xA1B2C3D4, 2, 4, 0, 0, 65535, link)


def frame(payload, source="10.0.0.1", port=2055, link=capture.RAW, v6=False):
    udp = struct.pack(">HHHH", 5000, port, 8 + len(payload), 0) + payload
    if v6:
        ip = struct.pack(">IHBB", 6 << 28, len(udp), 17, 64) + socket.inet_pton(socket.AF_INET6, source) + bytes(16)
    else:
        ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(udp), 1, 0, 64, 17, 0) + socket.inet_aton(source) + bytes(4)
    return (bytes(12) + (b"\x86\xdd" if v6 else b"\x08\x00") if link == capture.ETHERNET else b"") + ip + udp


def record(data, at, order="<", parts=1):
    return struct.pack(order + "IIII", START + at // 1000, at % 1000 * 1000 * parts, len(data), len(data)) + data


def test_parts_of_files(spark, tmp_path):
    """Each datagram once, wherever files are cut; payloads look like headers and hold whole records."""
    order = {}
    for n in range(8):
        inner = record(frame(b"inner"), 5) * 3
        frames = [frame(struct.pack(">HI", 5, i) + (inner if i % 7 == 0 else b"\0" * (i % 90)), f"10.0.{n}.{i % 250}") for i in range(400)]
        (tmp_path / f"{n}.pcap").write_bytes(head() + b"".join(record(f, i) for i, f in enumerate(frames)))
        order[f"{n}.pcap"] = [f[28:] for f in frames]
    capture.register(spark)
    for split in (10**9, 5000, 1237):
        got = spark.read.format("capture").option("splitBytes", split).load(str(tmp_path))
        assert got.rdd.getNumPartitions() >= (8 if split > 10**6 else 40)
        rows = got.collect()
        for n in range(8):
            own = sorted((r for r in rows if r.path.endswith(f"/{n}.pcap")), key=lambda r: r.position)
            assert [bytes(r.packet) for r in own] == order[f"{n}.pcap"]
    assert {(r.source_port, r.port) for r in rows} == {(5000, 2055)} and rows[0].received_at.year == 2026


@pytest.mark.parametrize(("link", "order", "nanos"), [(capture.RAW, ">", False), (capture.ETHERNET, "<", True)])
def test_formats(spark, tmp_path, link, order, nanos):
    frames = [frame(b"\0\5a", link=link), frame(b"\0\tb", "2001:db8::1", link=link, v6=True), b"\0" * 14 if link == capture.ETHERNET else b"\x45", b"", frame(b"\0\5c", port=9, link=link)]
    (tmp_path / "a.pcap").write_bytes(head(link, order, nanos) + b"".join(record(f, 1500 + i, order, 1000 if nanos else 1) for i, f in enumerate(frames)))
    capture.register(spark)
    got = spark.read.format("capture").option("port", 2055).load(str(tmp_path / "a.pcap")).orderBy("position").collect()
    assert [(bytes(r.packet), r.source_ip) for r in got] == [(b"\0\5a", "10.0.0.1"), (b"\0\tb", "2001:db8::1")]
    assert got[0].received_at.microsecond == 500_000
    (tmp_path / "b.pcap").write_bytes(b"no capture file, but longer than a head")
    with pytest.raises(Exception, match="not a capture file"):
        spark.read.format("capture").load(str(tmp_path / "b.pcap")).collect()


def test_stream_resumes_at_its_offset(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    capture.register(spark)

    def run():
        stream = spark.readStream.format("capture").load(str(source))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(bytes(r.packet) for r in spark.read.schema(capture.SCHEMA).parquet(out).collect())

    parts = [record(frame(f"{i:03}".encode()), i) for i in range(30)]
    whole = head() + b"".join(parts[:10])
    (source / "a.pcap").write_bytes(whole + parts[10][:20])  # the last one isn't whole yet
    assert run() == [f"{i:03}".encode() for i in range(10)]
    (source / "a.pcap").write_bytes(whole + b"".join(parts[10:20]))
    (source / "b.pcap").write_bytes(head() + b"".join(parts[20:]))
    assert run() == [f"{i:03}".encode() for i in range(30)] == run()


def test_ways_to_decoders(spark, tmp_path):
    packets = [v5(), v9(TEMPLATE, DATA), b"\0", b"\0\7rest", v5()[:-1], b""]
    (tmp_path / "a.pcap").write_bytes(head() + b"".join(record(frame(p), i) for i, p in enumerate(packets)))
    capture.register(spark)
    got = spark.read.format("capture").load(str(tmp_path)).withColumn("source_host", F.lit("h"))
    ways = capture.decode(got, {5: "five", 9: "nine"}, ("five", "nine"))
    assert ways["netflow_v5"][0].count() == 2 and [r.error for r in ways["netflow_v5"][1].collect()] == ["invalid_packet"]
    assert [r.fields[8] for r in ways["netflow_v9"][0].collect()] == ["192.168.1.10"] and ways["netflow_v9"][1].count() == 0
    assert sorted(r.error for r in ways["refused"][1].collect()) == ["malformed_packet", "malformed_packet", "unsupported_version"]
    errors = [r.error for r in capture.admitted(got, {5: "five", 9: "nine"}, ("five",)).orderBy("position").collect()]
    assert errors == [None, "unauthorized_collector", "malformed_packet", "unsupported_version", None, "malformed_packet"]
    long = spark.createDataFrame([(bytearray(b"\0\5" + b"x" * 65534),)], "packet binary")
    assert capture.admitted(long, {5: "five"}, ("five",)).first().error == "packet_too_large"
    with pytest.raises(ValueError, match="no decoder"):
        capture.admitted(got, {7: "x"}, ())
