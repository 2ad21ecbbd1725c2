"""What the charts show of metric points: which widget a metric belongs to, the name and value of its series, and figures of a window."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics of each widget, and names of series.
WIDGETS = {
    "ingestion": ("flow_records_normalized_total", "flow_records_stored_total"),
    "deadLetter": ("flow_records_failed_total", "rate_limit_rejections_total"),
    "dbLatency": (
        "storage_insert_duration", "storage_insert_duration_milliseconds", "storage_insert_duration_milliseconds_total", "storage_insert_duration_count",
        "storage_insert_duration_p90", "storage_insert_duration_p95", "storage_insert_duration_p99",
    ),
    "kafkaLag": ("kafka_consumer_lag",),
}
COUNTERS = ("ingestion", "deadLetter")
SOURCES = {"netflow_v5": "NetFlow v5", "netflow_v9": "NetFlow v9", "rest_json": "REST", "zeek_conn_json": "Zeek"}
LATENCY, LAG = "storage_insert_duration", "kafka_consumer_lag"


def widget(name: Column) -> Column:
    """The widget of a metric, or null."""
    return F.coalesce(*[F.when(name.isin(*names), F.lit(w)) for w, names in WIDGETS.items()])


def source_label(value: Column) -> Column:
    plain = F.trim(value)
    key = F.regexp_replace(F.lower(plain), "^source_type_", "")
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in SOURCES.items()], plain)


def series_label(name: Column, labels: Column) -> Column:
    """The name of a metric's series in its widget; labels: map<string,string>."""
    get = lambda k: F.get(F.transform(F.filter(F.map_entries(labels), lambda e: e["key"] == k), lambda e: e["value"]), 0)
    topic, partition = F.coalesce(get("topic"), F.lit("topic")), F.nullif(get("partition"), F.lit(""))
    of = widget(name)
    latency = F.when(name.endswith("_p90"), "p90").when(name.endswith("_p95"), "p95").when(name.endswith("_p99"), "p99").otherwise("Average")
    return (
        F.when(name == "flow_records_stored_total", "Persisted").when(of == "ingestion", F.coalesce(source_label(F.nullif(get("source_type"), F.lit(""))), F.lit("unknown_source")))
        .when(name == "rate_limit_rejections_total", "Rate Limited").when(of == "deadLetter", F.coalesce(get("reason"), F.lit("unknown_reason")))
        .when(of == "dbLatency", latency).when(of == "kafkaLag", F.coalesce(F.concat(topic, F.lit(":"), partition), topic))
    )


def series(points: DataFrame, width: int) -> DataFrame:
    """bucket, widget, series and value of points (bucket, metric_name, labels, delta, avg, last, max, p90, p95, p99).

    Counters show their rate over `width` seconds, gauges their mean, else last, else greatest value. The latency has a series
    for its mean and for each percentile that there is.
    """
    of = widget(F.col("metric_name"))
    rate, level = F.coalesce("delta", F.lit(0)) / F.lit(float(width)), F.coalesce("avg", "last", "max", F.lit(0.0))
    one = lambda name, value: F.struct(name.alias("series"), value.cast("double").alias("value"))
    plain = F.array(one(series_label(F.col("metric_name"), F.col("labels")), F.when(of.isin(*COUNTERS), rate).otherwise(level)))
    several = F.filter(F.array(*[one(F.lit(n), F.col(c)) for n, c in (("Average", "avg"), ("p90", "p90"), ("p95", "p95"), ("p99", "p99"))]), lambda x: x["value"].isNotNull())
    shown = points.where(of.isNotNull()).select("bucket", of.alias("widget"), F.explode(F.when(F.col("metric_name") == LATENCY, several).otherwise(plain)).alias("s"))
    return shown.select("bucket", "widget", "s.series", "s.value")


def summary(points: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """One row of figures of a window, rounded to 3 places: what was gained, rates in a second, lag and latency weighted by count.

    Counters only count what they gained. An empty window has zeros throughout.
    """
    seconds = max(1.0, (end - start).total_seconds())
    named = lambda n: F.col("metric_name") == n
    gained = lambda n: F.coalesce(F.sum(F.when(named(n), F.greatest(F.lit(0), F.coalesce("delta", F.lit(0))))), F.lit(0)).cast("double")
    weight = F.greatest(F.lit(1), "count")

    def weighted(n: str, value: Column) -> Column:
        own = named(n) & value.isNotNull()
        return F.coalesce(F.sum(F.when(own, value * weight)).cast("double") / F.sum(F.when(own, weight)), F.lit(0.0))

    level = F.coalesce("avg", "last", "max", F.lit(0.0))
    got = points.agg(
        gained("flow_records_normalized_total").alias("total_ingested"), gained("flow_records_stored_total").alias("total_persisted"), gained("flow_records_failed_total").alias("total_failed"),
        gained("rate_limit_rejections_total").alias("total_rate_limited"), F.coalesce(F.max(F.when(named(LAG), F.coalesce("max", "last", "avg", F.lit(0)))), F.lit(0)).cast("double").alias("max_lag"),
        weighted(LAG, level).alias("avg_lag"), weighted(LATENCY, F.col("avg")).alias("avg_latency_ms"), weighted(LATENCY, F.col("p95")).alias("p95_latency_ms"),
        weighted(LATENCY, F.col("p99")).alias("p99_latency_ms"), F.coalesce(F.sum(F.greatest(F.lit(0), "count")), F.lit(0)).alias("sample_count"),
    )
    c, third = F.col, lambda x: F.round(x, 3)
    rated = got.withColumns({
        "persist_success_rate": F.when(c("total_ingested") > 0, c("total_persisted") / c("total_ingested") * 100).otherwise(0.0),
        "average_ingest_rate": c("total_ingested") / seconds, "average_persist_rate": c("total_persisted") / seconds,
    })
    return rated.select(*[c(n) if n == "sample_count" else third(c(n)).alias(n) for n in rated.columns])


def live(snapshots: DataFrame, points: DataFrame, width: int = 5) -> DataFrame:
    """One row: total lag of snapshots (metric_name, value), the rate of the last bucket of points (bucket, metric_name, delta) and the seconds to drain.

    The seconds are null if nothing waits or nothing is stored.
    """
    lag = snapshots.where(F.col("metric_name") == LAG).agg(F.coalesce(F.sum("value"), F.lit(0)).cast("double").alias("lag"))
    stored = points.where(F.col("metric_name") == "flow_records_stored_total").groupBy("bucket").agg(F.sum(F.greatest(F.lit(0), "delta")).alias("gained"))
    rate = stored.agg(F.coalesce(F.max_by("gained", "bucket"), F.lit(0)).alias("gained")).select((F.col("gained") / F.lit(float(width))).alias("persist_rate"))
    none = F.lit(None).cast("double")
    both = lag.select("lag", none.alias("persist_rate")).unionByName(rate.select(none.alias("lag"), "persist_rate")).agg(F.max("lag").alias("lag"), F.max("persist_rate").alias("persist_rate"))
    return both.withColumn("drain_seconds", F.when((F.col("lag") > 0) & (F.col("persist_rate") > 0), F.col("lag") / F.col("persist_rate")))
