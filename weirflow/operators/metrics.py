"""Metric samples, their buckets, tiers, histograms and roll-ups, and the series that charts show."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import running

# Upper bounds of the duration buckets; the last bucket has none and counts as LAST_BOUND.
BOUNDS = (1, 2, 5, 10, 25, 50, 100, 250, 500, 1000, 2500, 5000, 10000)
LAST_BOUND = 10000.0
RESERVOIR = 1000
MOST_POINTS = 1000
PERCENTILES = ("p90", "p95", "p99")
SERIES = ("metric_name", "labels")


# The ranges of a history, with their bucket and their length; any other name is the second.
RANGES = {
    "1m": ("1 second", timedelta(minutes=1)), "1h": ("1 minute", timedelta(hours=1)), "12h": ("10 minutes", timedelta(hours=12)),
    "24h": ("20 minutes", timedelta(hours=24)), "1w": ("1 hour", timedelta(days=7)), "30d": ("8 hours", timedelta(days=30)),
}


def _at(df: DataFrame, column: str):
    """datetime -> literal, of the kind of time that the column has."""
    ntz = dict(df.dtypes)[column] == "timestamp_ntz"
    return (lambda t: F.lit(str(t)).cast("timestamp_ntz")) if ntz else F.lit


def history_of(samples: DataFrame, name: str, now: datetime, series: tuple[str, ...] = SERIES, time: str = "ts") -> DataFrame:
    """The history of a named range up to now, in order of bucket. There is a lower bound only: what is later than now shows."""
    interval, length = RANGES.get(name, RANGES["1h"])
    return history(samples.where(F.col(time) >= _at(samples, time)(now - length)), interval, series, time).orderBy("bucket", *series)


def history(samples: DataFrame, interval: str, series: tuple[str, ...] = SERIES, time: str = "ts") -> DataFrame:
    """bucket, series, delta (max - min) and value (mean) of samples; missing values count as 0."""
    w = F.window(time, interval)["start"].alias("bucket")
    mean = F.sum("value").cast("double") / F.count("value")
    return samples.groupBy(w, *series).agg(F.coalesce(F.max("value") - F.min("value"), F.lit(0)).alias("delta"), F.coalesce(mean, F.lit(0.0)).alias("value"))


def drain(samples: DataFrame, width: str = "5 seconds", series: tuple[str, ...] = SERIES, time: str = "ts", order: tuple[str, ...] = ("ts",), counter: bool = False) -> DataFrame:
    """Samples of a bucket as one row: sample_count, count, sum, min, max, first, last, delta.

    Of a counter, samples are increments and the counter stands at their sum: first is before the bucket, delta the
    bucket's increments. Of a gauge, first and last are samples and delta their difference.
    """
    by = F.struct(*order)
    w = F.window(time, width)["start"].alias("bucket")
    got = samples.groupBy(w, *series).agg(F.count("*").alias("sample_count"), F.count("value").alias("count"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"), F.min_by("value", by).alias("first"), F.max_by("value", by).alias("last"))
    if not counter:
        return got.withColumn("delta", F.col("last") - F.col("first"))
    got = running.running_sum(got, series, ("bucket",), F.col("sum"), "last")
    return got.withColumn("first", F.col("last") - F.col("sum")).withColumn("delta", F.col("sum"))


def within(samples: DataFrame, start: datetime, end: datetime, width: int = 5, time: str = "ts") -> DataFrame:
    """Samples of the buckets of `width` seconds that begin in [start, end): a range of time that reaches the scan, widened to whole buckets."""
    at = _at(samples, time)
    epoch, whole = datetime(1970, 1, 1), timedelta(seconds=width)
    floor = lambda t: epoch + (t - epoch) // whole * whole
    return samples.where((F.col(time) >= at(floor(start))) & (F.col(time) < at(floor(end + whole - timedelta(microseconds=1)))))


def bucket_index(value: Column) -> Column:
    """The place of the first bound that isn't below a value."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in BOUNDS]), lambda b: b < value))


def upper_bound(index: Column) -> Column:
    return F.get(F.array(*[F.lit(float(b)) for b in BOUNDS]), index)


def histogram(samples: DataFrame, width: str, series: tuple[str, ...] = SERIES, time: str = "ts") -> DataFrame:
    """bucket, series, bucket_index, bucket_upper_bound (null for the last), count."""
    counted = samples.where("value is not null").groupBy(F.window(time, width)["start"].alias("bucket"), *series, bucket_index(F.col("value")).alias("bucket_index")).agg(F.count("*").alias("count"))
    return counted.withColumn("bucket_upper_bound", upper_bound(F.col("bucket_index")))


def widen_histogram(buckets: DataFrame, width: str, series: tuple[str, ...] = SERIES) -> DataFrame:
    """The histogram tier of a wider bucket."""
    return buckets.groupBy(F.window("bucket", width)["start"].alias("bucket"), *series, "bucket_index", "bucket_upper_bound").agg(F.sum("count").alias("count"))


def percentiles(buckets: DataFrame, keys: tuple[str, ...], quantiles: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """keys and p90, p95, ...: the upper bound of the first bucket at which the running count reaches ceil(q * n), and 1."""
    summed = buckets.groupBy(*keys, "bucket_index").agg(F.sum("count").alias("count"))
    run = Window.partitionBy(*keys).orderBy("bucket_index")
    counted = summed.withColumn("so_far", F.sum("count").over(run)).withColumn("n", F.sum("count").over(Window.partitionBy(*keys)))
    bound = F.coalesce(upper_bound(F.col("bucket_index")), F.lit(LAST_BOUND))
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n")))
    return counted.groupBy(*keys).agg(*[F.coalesce(F.min(F.when(F.col("so_far") >= rank(q), bound)), F.lit(0.0)).alias(f"p{round(q * 100)}") for q in quantiles])


def nearest_rank(samples: DataFrame, quantile: float, keys: tuple[str, ...], order: tuple[str, ...] = ("ts",), last: int = RESERVOIR) -> DataFrame:
    """keys and value: the sample of rank ceil(q * n) among the latest `last` ones. Spark cuts groups to that many before it shuffles."""
    recent = samples.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).where(f"_r <= {last}")
    return recent.groupBy(*keys).agg(F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY value)").alias("value"))


def aggregate_tier(base: DataFrame, width: str, series: tuple[str, ...] = SERIES) -> DataFrame:
    """Base buckets (as `drain` makes them) in wider ones. avg is of sums; percentiles can't be merged: p90, p95, p99 are null, and histograms have them."""
    at = F.window("bucket", width)["start"].alias("bucket")
    known = lambda c, by: F.expr(f"{by}({c}, bucket) FILTER (WHERE {c} IS NOT NULL)").alias(c)
    got = base.withColumnRenamed("bucket", "_b").withColumn("bucket", F.col("_b")).groupBy(at, *series).agg(
        *[F.sum(c).alias(c) for c in ("sample_count", "count", "sum", "delta")], F.min("min").alias("min"), F.max("max").alias("max"), known("first", "min_by"), known("last", "max_by"))
    got = got.withColumn("avg", F.col("sum").cast("double") / F.nullif(F.col("count"), F.lit(0)))
    return got.withColumns({p: F.lit(None).cast("double") for p in PERCENTILES})


class MetricError(ValueError):
    """A metric query that isn't allowed; args: code and message."""


@dataclass(frozen=True)
class MetricQuery:
    """What a chart asks for: steps of `step` seconds (by default, the base width) from start on; metrics: names, none for all."""

    start: datetime
    end: datetime
    step: int | None = None
    metrics: tuple[str, ...] = ()

    def check(self, width: int = 5, most: int = MOST_POINTS) -> int:
        """The step, if the query is allowed."""
        step = self.step if self.step is not None else width
        if not self.start < self.end:
            raise MetricError("invalid_parameter", "start must be before end")
        if step < width or step % width:
            raise MetricError("invalid_parameter", f"step must be a multiple of {width} seconds")
        if -(-(self.end - self.start) // timedelta(seconds=step)) > most:
            raise MetricError("query_window_too_large", f"at most {most} points")
        return step


def points(tables: dict[str, tuple[DataFrame, DataFrame | None]], q: MetricQuery, width: int = 5, series: tuple[str, ...] = SERIES) -> DataFrame:
    """The chart's points in order of bucket, metric and labels. tables: base, 5m and 1h, each (aggregates, histogram or None).

    The length of the window decides which of them answers; rows of other bucket widths in a table are left out.
    """
    from ..plans.router import metric_tier

    step = q.check(width)
    which = metric_tier(q.end - q.start)
    wide = {"base": width, "5m": 300, "1h": 3600}[which]

    def wanted(df: DataFrame | None) -> DataFrame | None:
        if df is None:
            return None
        df = df.where(F.col("bucket_width_seconds") == wide) if "bucket_width_seconds" in df.columns else df
        names = sorted({m.strip() for m in q.metrics} - {""})
        return df.where(F.col("metric_name").isin(*names)) if names else df

    return rollup(*map(wanted, tables[which]), q.start, q.end, step, wide, series).orderBy("bucket", *series)


def rollup(base: DataFrame, buckets: DataFrame | None, start: datetime, end: datetime, step: int, width: int = 5, series: tuple[str, ...] = SERIES) -> DataFrame:
    """Base buckets of `width` seconds in steps of `step` seconds from `start`, with rates, and percentiles by histogram.

    Both inputs are aggregated and joined in full, so a series that only has a histogram has its points too. Where there is none,
    the greatest stored percentile of a step stands in, if base has any. Rates are of counters (metric_kind) that have no histogram.
    Points: bucket, series, sample_count, count, sum, avg, min, max, first, last, delta, rate_avg, rate_peak, p90, p95, p99.
    """
    ntz = dict(base.dtypes)["bucket"] == "timestamp_ntz"
    lit = (lambda t: F.lit(str(t)).cast("timestamp_ntz")) if ntz else F.lit
    offset = int((start - datetime(1970, 1, 1)).total_seconds()) % step
    at = F.window("bucket", f"{step} seconds", f"{step} seconds", f"{offset} seconds")["start"]
    inside = lambda df: df.where((F.col("bucket") >= lit(start)) & (F.col("bucket") < lit(end)))
    known = lambda c, by: F.expr(f"{by}({c}, bucket) FILTER (WHERE {c} IS NOT NULL)").alias(c)
    rated = (F.col("metric_kind") == "counter") if "metric_kind" in base.columns else F.lit(False)
    peak = F.max(F.when(rated, F.col("delta")) / F.lit(float(width))).alias("rate_peak")
    stored = [p for p in PERCENTILES if p in base.columns]
    points = inside(base).groupBy(at.alias("at"), *series).agg(*[F.sum(c).alias(c) for c in ("sample_count", "count", "sum", "delta")], F.min("min").alias("min"), F.max("max").alias("max"), known("first", "min_by"), known("last", "max_by"), peak, F.sum(F.when(rated, F.col("delta"))).alias("_rated"), *[F.max(p).alias(f"_{p}") for p in stored])
    points = points.withColumn("avg", F.col("sum").cast("double") / F.coalesce(F.nullif(F.col("count"), F.lit(0)), F.nullif(F.col("sample_count"), F.lit(0))))
    points = points.withColumn("rate_avg", F.col("_rated") / F.lit(float(step))).drop("_rated")
    if buckets is not None:
        wide = inside(buckets).withColumn("at", at)
        told = percentiles(wide, ("at", *series)).withColumn("_told", F.lit(True))
        points = points.join(told, ["at", *series], "full_outer")
        points = points.withColumns({r: F.when(F.col("_told").isNull(), F.col(r)) for r in ("rate_avg", "rate_peak")}).drop("_told")
    elif stored:
        points = points.withColumns({p: F.lit(None).cast("double") for p in PERCENTILES})
    for p in stored:
        points = points.withColumn(p, F.coalesce(p, f"_{p}")).drop(f"_{p}")
    return points.withColumnRenamed("at", "bucket")


def clamped_delta(samples: DataFrame, series: tuple[str, ...] = SERIES, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """samples, of a batch or a stream, with `delta`: what a counter gained since the sample before; 0 at first and when it was reset."""
    (was,) = running.unused(samples, "_was")
    if samples.isStreaming:
        from ..streaming.series import previous
    else:
        previous = running.previous
    found = previous(samples, series, order, ("value",), was)
    return found.withColumn("delta", F.coalesce(F.greatest(F.lit(0), F.col("value") - F.col(f"{was}.value")), F.lit(0))).drop(was)


def summary(points: DataFrame, series: tuple[str, ...] = SERIES) -> DataFrame:
    """Of points (delta, count, avg, max): gained, samples, mean weighted by count, peak; to 3 places."""
    return points.groupBy(*series).agg(
        F.sum(F.greatest(F.lit(0), "delta")).alias("gained"), F.sum("count").alias("samples"),
        F.round(F.sum(F.col("avg") * F.col("count")) / F.nullif(F.sum("count"), F.lit(0)), 3).alias("mean"), F.max("max").alias("peak"))


def fill_gaps(points: DataFrame, start: datetime, end: datetime, step: int, value: str = "value", series: tuple[str, ...] = SERIES) -> DataFrame:
    """A row for each series and each bucket from start to end, both included; 0 where points have none."""
    first = lambda t: F.lit(str(t)).cast("timestamp_ntz")
    listed = points.select(*series).distinct().withColumn("bucket", F.explode(F.sequence(first(start), first(end), F.expr(f"interval {step} seconds"))))
    return listed.join(points, [*series, "bucket"], "left").select("bucket", *series, F.coalesce(value, F.lit(0)).alias(value))


def pivot(points: DataFrame, names: list[str], value: str = "value", name: str = "metric_name") -> DataFrame:
    """bucket, a column for each of `names`, and their total."""
    wide = points.groupBy("bucket").pivot(name, names).agg(F.sum(value))
    wide = wide.select("bucket", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).alias(n) for n in names])
    return wide.withColumn("total", sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`")))


def latency(points: DataFrame, total: str, count: str, series: tuple[str, ...] = ("labels",)) -> DataFrame:
    """bucket, series, latency: gained total over gained count. One aggregation pairs the two metrics.

    Where the count gained nothing, what both stand at (value, if points have it) is taken instead; 0 where that has no count either.
    """
    pick = lambda m, c="delta": F.sum(F.when(F.col("metric_name") == m, F.greatest(F.lit(0), c)))
    stands = "value" in points.columns
    got = points.where(F.col("metric_name").isin(total, count)).groupBy("bucket", *series).agg(
        pick(total).alias("t"), pick(count).alias("n"), *[pick(m, "value").alias(c) for m, c in ((total, "tv"), (count, "nv")) if stands])
    ratio = lambda a, b: F.col(a).cast("double") / F.nullif(F.col(b), F.lit(0))
    return got.where("t is not null and n is not null").select("bucket", *series, F.coalesce(ratio("t", "n"), *[ratio("tv", "nv")] * stands, F.lit(0.0)).alias("latency"))


def unpivot(points: DataFrame, columns: list[str], keys: tuple[str, ...]) -> DataFrame:
    return points.unpivot([F.col(k) for k in keys], columns, "statistic", "value").where("value is not null")


def health(states: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """ok if all components are, fail if all failed, else degraded; from rows with `status`."""
    n, ok, bad = F.count("*"), F.count_if(F.col("status") == "ok"), F.count_if(F.col("status") == "fail")
    return states.groupBy(*keys).agg(F.when(ok == n, "ok").when(bad == n, "fail").otherwise("degraded").alias("status"), n.alias("components"))


def latest(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Upsert semantics: of rows with equal keys, the last written."""
    row = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(row).select("row.*")


def exposition(samples: DataFrame, labels: str = "labels") -> DataFrame:
    """One line of text, `name{labels} value`, for each sample; in order of name and labels when collected."""
    from ..functions.flow import labels_text

    text = labels_text(F.col(labels))
    return samples.select(F.concat(F.col("metric_name"), F.when(text != "", F.concat(F.lit("{"), text, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"), "metric_name", text.alias("labels_text")).orderBy("metric_name", "labels_text").select("line")


def read_exposition(lines: DataFrame, column: str = "value") -> DataFrame:
    """metric_name, labels and value of each sample line; comments and other lines are left out."""
    pattern = r'^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)$'
    pairs = F.regexp_extract_all(F.regexp_extract(column, pattern, 2), F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'), F.lit(0))
    raw = lambda p: F.regexp_extract(p, r'^[^=]+="((?s:.*))"$', 1)
    plain = lambda v: F.replace(F.replace(F.replace(F.replace(v, F.lit("\\\\"), F.lit("\0")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\0"), F.lit("\\"))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]+)=", 1).alias("key"), plain(raw(p)).alias("value"))))
    return lines.where(F.col(column).rlike(pattern)).select(F.regexp_extract(column, pattern, 1).alias("metric_name"), labels.alias("labels"), F.regexp_extract(column, pattern, 3).try_cast("double").alias("value"))
