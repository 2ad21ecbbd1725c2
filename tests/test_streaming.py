import json
from datetime import datetime

from pyspark.sql import functions as F

from tests.test_sources import DATA, TEMPLATE, v9
from weirflow.operators import normalize, store
from weirflow.sources import netflow9, rest
from weirflow.streaming import jobs


def lines(n, start=0):
    return [json.dumps({"external_id": f"e{i}", "event_start_time": f"2026-06-{16 + i % 2}T10:00:{i % 60:02d}Z", "src_ip": "bad" if i == 3 else "10.0.0.1", "dst_ip": "8.8.8.8", "src_port": 1, "dst_port": 2, "transport_protocol": "tcp", "protocol_number": 6, "bytes": 10, "packets": 1}) for i in range(start, start + n)]


def records(df):
    at = F.lit("2026-06-20 00:00:00").cast("timestamp")
    return rest.parse(df.withColumns({"event_id": F.lit("01934d7c-79b4-7000-8b69-001122334455"), "source_type": F.lit("rest_json"), "collector_id": F.lit("c"), "source_host": F.lit("h"), "source_ip": F.lit("10.9.9.9"), "received_at": at}))


def test_stream_equals_batch_and_repeats_add_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(lines(10)) + "\n")
    paths = [str(tmp_path / x) for x in ("flows", "letters", "checkpoint")]
    run = lambda: jobs.ingest(records(spark.readStream.text(str(source))), normalize.rest, *paths, str(tmp_path / "tiers")).awaitTermination(120)
    run()
    (source / "b.json").write_text("\n".join(lines(10, 5)) + "\n")  # half of them again
    run()
    flows = store.read(spark, paths[0])
    batch, bad = normalize.split(normalize.rest(records(spark.read.text(str(source)))))
    assert flows.count() == 14 == batch.dropDuplicates(["idempotency_key"]).count() and bad.count() == 1
    assert sorted(r[0] for r in flows.select("idempotency_key").collect()) == sorted(r[0] for r in batch.select("idempotency_key").distinct().collect())
    letters = spark.read.parquet(paths[1]).collect()
    assert [(r.stage, r.error_code, r.truncated) for r in letters] == [("normalizer", "invalid_src_ip", False)]
    tiers = {name: spark.read.parquet(str(tmp_path / "tiers" / name)).agg(F.sum("flow_count"), F.sum("total_bytes")).first() for name in ("talkers_5m", "talkers_1h", "ports_5m", "ports_1h")}
    assert {tuple(v) for v in tiers.values()} == {(14, 140)}
    again = store.append(batch, paths[0]).first()
    assert (again.attempted, again.inserted) == (batch.count(), 0)
    assert store.retained(flows, datetime(2026, 7, 17)).count() == 6


def test_stream_notes_partial_sums(spark, tmp_path):
    from weirflow.operators import tiers

    source = tmp_path / "in"
    source.mkdir()
    paths = [str(tmp_path / x) for x in ("flows", "letters", "checkpoint", "tiers")]
    run = lambda: jobs.ingest(records(spark.readStream.text(str(source))), normalize.rest, *paths, partial=True).awaitTermination(120)
    (source / "a.json").write_text("\n".join(lines(10)) + "\n")
    run()
    tiers.fold(spark, paths[3])
    (source / "b.json").write_text("\n".join(lines(10, 5)) + "\n")  # half of them again
    run()
    for kind in tiers.TIERS:
        for width in tiers.WIDTHS:
            assert tuple(tiers.current(spark, paths[3], kind, width).agg(F.sum("flow_count"), F.sum("total_bytes")).first()) == (14, 140)


def test_netflow9_stream(spark, tmp_path):
    at = datetime(2026, 6, 16, 10, 15, 20)
    schema = "collector_id string, source_host string, source_ip string, source_id long, packet binary, received_at timestamp"
    row = lambda p: ("main", "host", "10.0.0.1", 7, bytearray(p), at)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run(packets):
        spark.createDataFrame([row(p) for p in packets], schema).coalesce(1).write.mode("append").parquet(source)
        query = jobs.decode_netflow9(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()  # with timers, availableNow goes on
        try:
            assert query.awaitTermination(60)
        finally:
            query.stop()
        return sorted(r.packet_sequence for r in spark.read.schema(netflow9.SCHEMA).parquet(out).collect())

    assert run([v9(DATA, seq=1)]) == []
    assert run([v9(TEMPLATE, seq=2), v9(DATA, seq=3)]) == [1, 3]
    assert run([v9(DATA, seq=4)]) == [1, 3, 4]


def test_netflow9_stream_equals_batch(spark, tmp_path):
    """Packets in shuffled micro-batches, the query started anew from its checkpoint for each: the rows of the state packet by packet."""
    import random

    from tests.test_netflow9 import KEYS, history, key_of
    from weirflow.streaming import netflow9 as stream9

    rows, source, out = sorted(history(1, 2, 130), key=lambda r: (r[5], r[6])), str(tmp_path / "in"), str(tmp_path / "out")
    for at in range(0, len(rows), 90):
        part = rows[at : at + 90]
        random.Random(at).shuffle(part)
        spark.createDataFrame(part, KEYS).repartition(3).write.mode("append").parquet(source)
        query = stream9.decode(spark.readStream.schema(KEYS).parquet(source), options=True).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
        try:
            assert query.awaitTermination(120)
        finally:
            query.stop()
    got = spark.read.schema(netflow9.ALL).parquet(out).collect()
    want = netflow9.decoded(spark.createDataFrame(rows, KEYS)).collect()
    still = lambda r: r.error == "pending_expired"  # noqa: E731  streams tell of it when time goes on, batches at their end
    came, due = (sorted((key_of(r) for r in x if not still(r)), key=repr) for x in (got, want))
    assert [x for x in came if x not in due] == [] and [x for x in due if x not in came] == [] and came == due
    assert {key_of(r) for r in got if still(r)} <= {key_of(r) for r in want if still(r)}
    assert any(r.scopes for r in got) and any(r.error == "exporter_restart" for r in got)
