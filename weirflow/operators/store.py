"""The flow table: parquet partitioned by event_date, appended without duplicates, and its tiers."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .flows import PORTS, TALKERS, first_wins, tier
from .metrics import latest

KEY = ("event_start_time", "idempotency_key")
#: Flows of a file, about.
FILE_ROWS = 5_000_000


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None if nothing was written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def append(flows: DataFrame, path: str, first: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Append the flows that the table lacks; returns attempted, inserted and deduplicated. What is given is computed once.

    The key has the start time, so a flow's twin can only be in its own day: only touched partitions are read. The days
    of a batch come to the driver, not its rows. Written twice, a batch adds nothing. `first` gets what will be written before it is.
    """
    spark = flows.sparkSession
    given = Observation()
    fresh = first_wins(flows.observe(given, F.count(F.lit(1)).alias("rows")), KEY).withColumn("event_date", F.to_date("event_start_time")).persist()
    try:
        days = [r[0] for r in fresh.select("event_date").distinct().collect()]
        stored = read(spark, path)
        if stored is not None and days:
            fresh_only = fresh.join(stored.where(F.col("event_date").isin(days)).select(*KEY), list(KEY), "left_anti")
        else:
            fresh_only = fresh
        inserted = fresh_only.select(*fresh.columns).persist()
        n = inserted.count()
        if first:
            first(inserted)
        most = n // FILE_ROWS + 1  # writers of a day, by what there is to write
        inserted.repartition("event_date", F.pmod(F.xxhash64("id"), F.lit(most))).sortWithinPartitions(F.desc("event_start_time")).write.mode("append").partitionBy("event_date").parquet(path)
        attempted = given.get["rows"]
        inserted.unpersist()
        return spark.createDataFrame([(attempted, n, attempted - n)], "attempted long, inserted long, deduplicated long")
    finally:
        fresh.unpersist()


def refresh(spark: SparkSession, flows_path: str, tiers_path: str, days: list) -> None:
    """Recompute the tiers of these days and overwrite just their partitions; late flows are seen whenever their day is refreshed."""
    flows = spark.read.parquet(flows_path).where(F.col("event_date").isin(days))
    for kind, keys in (("talkers", TALKERS), ("ports", PORTS)):
        for width in ("5m", "1h"):
            out = tier(flows, width, keys).withColumn("event_date", F.to_date("bucket"))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(f"{tiers_path}/{kind}_{width}")


#: How often a tier is computed anew, and over which time before now.
REFRESH = {"5m": (timedelta(minutes=1), timedelta(hours=24)), "1h": (timedelta(minutes=5), timedelta(days=7))}


def due(width: str, last: datetime | None, now: datetime) -> list[date]:
    """The days to refresh for tiers of that width; none before its time. Without a last run, that is the backfill at the start."""
    every, back = REFRESH[width]
    if last is not None and now - last < every:
        return []
    first = (now - back).date()
    return [first + timedelta(days=i) for i in range((now.date() - first).days + 1)]


def expire(spark: SparkSession, path: str, now: datetime, days: int = 30) -> list[str]:
    """Delete the partitions of days that ended more than `days` days ago; returns their names. Only names of folders are read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    limit = f"event_date={(now - timedelta(days=days)).date()}"
    gone = sorted(n for s in fs.listStatus(folder) if (n := s.getPath().getName()).startswith("event_date=") and n < limit)
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)
    return gone


def append_snapshots(samples: DataFrame, path: str) -> None:
    """Metric samples as they come, by day."""
    samples.withColumn("event_date", F.to_date("ts")).write.mode("append").partitionBy("event_date").parquet(path)


def append_logs(logs: DataFrame, path: str) -> None:
    """Log lines (timestamp, level, message, attributes: a map) by day; attributes as JSON, {} if there are none."""
    text = F.coalesce(F.to_json("attributes"), F.lit("{}"))
    logs.withColumn("attributes", text).withColumn("event_date", F.to_date("timestamp")).write.mode("append").partitionBy("event_date").parquet(path)


def upsert(rows: DataFrame, path: str, keys: tuple[str, ...], order: tuple[str, ...], time: str = "bucket") -> None:
    """Write rows over those with equal keys; the last by `order` stays. Only partitions of touched days are read and written, under a new copy."""
    spark = rows.sparkSession
    fresh = rows.withColumn("event_date", F.to_date(time)).persist()
    try:
        days = [r[0] for r in fresh.select("event_date").distinct().collect()]
        stored = read(spark, path)
        if stored is not None and days:
            fresh_all = stored.where(F.col("event_date").isin(days)).select(*fresh.columns).unionByName(fresh)
        else:
            fresh_all = fresh
        done = latest(fresh_all, keys, order).persist()
        done.count()  # read before it is overwritten
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
        done.unpersist()
    finally:
        fresh.unpersist()


STATE = "state_key string, collector_id string, source_type string, source_host string, state string, updated_at timestamp"


def save_state(states: DataFrame, path: str) -> None:
    """Collector states, appended; `load_state` reads the last one of a key."""
    states.select(*[c.split()[0] for c in STATE.split(", ")]).write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """The last state written of one key, or of each; no row if there is none."""
    if key is not None and not key.strip():
        raise ValueError("a state key is required")
    stored = read(spark, path)
    stored = spark.createDataFrame([], STATE) if stored is None else stored
    return latest(stored.where(F.col("state_key") == key) if key is not None else stored, ("state_key",), ("updated_at", "state"))


def retained(flows: DataFrame, now, days: int = 30) -> DataFrame:
    """Flows of the last `days` days: by event_date a matter of partitions."""
    return flows.where(F.col("event_start_time") >= F.lit(now) - F.expr(f"interval {days} days"))
