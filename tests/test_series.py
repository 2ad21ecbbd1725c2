"""What series take from the rows before: by spans, by state, and by plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow.operators import metrics, running
from weirflow.sources import netflow5

T = datetime(2026, 6, 18, 5)


def rows_of(seed, n=300):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), T + timedelta(seconds=rng.choice([1, 50, 4000, 90000]) * i / 10), i, rng.choice([None, *range(50)]), rng.randrange(1, 31)) for i in range(n)]


SCHEMA = "source_ip string, received_at timestamp, id long, sequence long, records long"


@pytest.mark.parametrize("seconds", [60, 3600, 10**9])
def test_previous_and_sums(spark, seconds):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    last, total, want = {}, {}, []
    for key, at, n, q, k in order:
        total[key] = total.get(key, 0) + (q or 0)
        want.append((n, last.get(key), total[key]))
        last[key] = (q, k)
    found = running.previous(df, ("source_ip",), ("received_at", "id"), ("sequence", "records"), seconds=seconds)
    found = running.running_sum(found, ("source_ip",), ("received_at", "id"), F.col("sequence"), seconds=seconds)
    assert found.columns == [*df.columns, "previous", "total"]
    assert sorted((r.id, tuple(r.previous) if r.previous else None, r.total) for r in found.collect()) == sorted(want)


def test_no_window_spans_a_history(spark):
    plan = netflow5.gaps(spark.createDataFrame(rows_of(1), SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if line.strip(" :+-").startswith("Window")]
    assert len(windows) >= 2 and all("part" in w for w in windows)


def parts(spark, tmp_path, rows, schema, each):
    """A stream of files with `each` rows, in order of time, shuffled within a file."""
    path = tmp_path / "in"
    for n, at in enumerate(range(0, len(rows), each)):
        part = rows[at : at + each]
        random.Random(at).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/{n:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def collected(stream, tmp_path, spark):
    out = str(tmp_path / "out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    return spark.read.parquet(out)


def test_gaps_of_a_stream(spark, tmp_path):
    rows = sorted((r for r in rows_of(5, 60) if r[3] is not None), key=lambda r: (r[1], r[2]))
    order = ("received_at", "id")
    got = collected(netflow5.gaps(parts(spark, tmp_path, rows, SCHEMA, 20), order=order), tmp_path, spark)
    want = netflow5.gaps(spark.createDataFrame(rows, SCHEMA), order=order)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("counter", [False, True])
def test_drain_of_a_stream(spark, tmp_path, counter):
    from weirflow.streaming import series

    rng, schema = random.Random(2), "metric_name string, labels string, ts timestamp, event_id long, value double"
    rows = [(rng.choice("mn"), "x", T + timedelta(seconds=i * 0.3), i, rng.choice([None, 0.5, 3.0, 70.0, 20000.0])) for i in range(120)]
    end = [("z", "x", T + timedelta(days=1), 10**6, 1.0)]
    stream = parts(spark, tmp_path, rows, schema, 40)
    spark.createDataFrame(end, schema).coalesce(1).write.parquet(str(tmp_path / "in" / "999"))
    got = collected(series.drain(stream.withWatermark("ts", "0 seconds"), "event_id", counter=counter, last=20), tmp_path, spark)
    df = spark.createDataFrame(rows, schema)
    want = metrics.drain(df, order=("ts", "event_id"), counter=counter)
    names = ["bucket", *metrics.SERIES, "sample_count", "count", "sum", "min", "max", "first", "last", "delta"]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(map(tuple, want.select(*names).collect()), key=repr)
    histogram = metrics.percentiles(metrics.histogram(df, "5 seconds"), ("bucket", *metrics.SERIES))
    own = {(r.bucket, r.metric_name): (r.p90, r.p95, r.p99) for r in histogram.collect()}
    assert all((r.p90, r.p95, r.p99) == own.get((r.bucket, r.metric_name), (0.0, 0.0, 0.0)) for r in got.collect())
    final = {r.metric_name: r.recent for r in got.orderBy("bucket").collect()}
    recent = metrics.nearest_rank(df.where("value is not null"), 0.95, ("metric_name",), ("ts", "event_id"), last=20)
    assert final == {r.metric_name: r.value for r in recent.collect()}
