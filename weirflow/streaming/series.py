"""State by series over micro-batches: the row before, and buckets of samples that close as time goes on.

Rows of a key are taken in order within a batch, and later batches are later. State is as large as what must be remembered: one row, or a
bucket's figures and its latest samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import metrics
from .netflow9 import PROVIDER


def _plain(x):
    return None if x is None or x is pd.NaT or isinstance(x, float) and np.isnan(x) else x.item() if hasattr(x, "item") else x


class Previous(StatefulProcessor):
    def __init__(self, keys: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...], schema: str, to: list[str]):
        self.keys, self.order, self.columns, self.schema, self.to = keys, list(order), list(columns), schema, to

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        pdf = pd.concat(list(rows)).assign(**dict(zip(self.keys, key, strict=True))).sort_values(self.order, kind="stable", na_position="first")
        values = [(*(_plain(x) for x in row), True) for row in pdf[self.columns].itertuples(index=False)]  # True: there is one
        before = [tuple(self.last.get()) if self.last.exists() else (None,) * len(self.to), *values[:-1]]
        yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(before, columns=self.to, dtype=object)], axis=1)
        self.last.update(values[-1])

    def close(self) -> None:
        pass


def previous(stream: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...], to: str = "previous") -> DataFrame:
    """What operators.running.previous gives, of a stream: a struct of the columns of the row before, null for a key's first.

    Sets the session's state store to RocksDB, which such state needs, for queries started from now on.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = dict(stream.dtypes)
    names = [f"{to}_{c}" for c in columns]
    there = f"{to}_is"
    state = ", ".join(f"`{c}` {kind[c]}" for c in columns) + f", `{there}` boolean"
    out = ", ".join(f"`{c}` {k}" for c, k in stream.dtypes) + ", " + ", ".join(f"`{n}` {kind[c]}" for n, c in zip(names, columns, strict=True)) + f", `{there}` boolean"
    found = stream.groupBy(*keys).transformWithStateInPandas(Previous(keys, order, columns, state, [*names, there]), out, "Append", "None")
    value = F.struct(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, columns, strict=True)])
    return found.withColumn(to, F.when(F.col(f"`{there}`"), value)).drop(*names, there)


_OPEN = "sample_count bigint, count bigint, sum double, low double, high double, first double, first_at array<bigint>, last double, last_at array<bigint>, histogram array<bigint>, times array<bigint>, ties array<bigint>, samples array<double>"
_RING = "times array<bigint>, ties array<bigint>, samples array<double>, total double"
FIGURES = "sample_count bigint, count bigint, sum double, min double, max double, first double, last double, delta double, p90 double, p95 double, p99 double, recent double"


def nearest(values: list[float], quantile: float) -> float | None:
    """The value of rank ceil(q * n)."""
    return sorted(values)[max(1, -(-int(round(quantile * len(values) * 1e9)) // 10**9)) - 1] if values else None


def bound_at(histogram: list[int], quantile: float) -> float:
    """The upper bound of the first bucket at which the running count reaches ceil(q * n), and 1; 0 without samples."""
    n, so_far = sum(histogram), 0
    rank = max(1, -(-int(round(quantile * n * 1e9)) // 10**9))
    for bound, count in zip((*map(float, metrics.BOUNDS), metrics.LAST_BOUND), histogram, strict=True):
        so_far += count
        if so_far >= rank:
            return bound
    return 0.0


class Drain(StatefulProcessor):
    """width in microseconds."""

    def __init__(self, series: tuple[str, ...], time: str, tie: str, width: int, counter: bool, quantile: float, last: int):
        self.series, self.time, self.tie, self.width, self.counter, self.quantile, self.most = series, time, tie, width, counter, quantile, last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "bucket bigint", _OPEN)
        self.ring = handle.getValueState("ring", _RING)

    def _latest(self, times: list, ties: list, samples: list) -> tuple[list, list, list]:
        order = sorted(range(len(times)), key=lambda i: (times[i], ties[i]))[-self.most :]
        return [times[i] for i in order], [ties[i] for i in order], [samples[i] for i in order]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows))
        pdf = pdf.assign(_at=pdf[self.time].astype("datetime64[us]").astype("int64")).sort_values(["_at", self.tie])
        for bucket, own in pdf.groupby(pdf["_at"] // self.width):
            values = own["value"].dropna().astype(float)
            ends = [(_plain(r["value"]), [int(r["_at"]), int(r[self.tie])]) for _, r in (next(own.iterrows()), list(own.iloc[-1:].iterrows())[0])]
            places = np.searchsorted(np.array(metrics.BOUNDS, float), values, side="left")
            histogram = np.bincount(places, minlength=len(metrics.BOUNDS) + 1)
            kept = own[own["value"].notna()].iloc[-self.most :]
            now = [len(own), len(values), float(values.sum()) if len(values) else None, *((float(values.min()), float(values.max())) if len(values) else (None, None)), *[x for v, at in ends for x in (None if v is None else float(v), at)],
                   histogram.tolist(), kept["_at"].tolist(), kept[self.tie].astype(int).tolist(), kept["value"].astype(float).tolist()]
            was = self.open.getValue((int(bucket),))
            self.open.updateValue((int(bucket),), tuple(now if was is None else self._merged(list(was), now)))
            self.handle.registerTimer((int(bucket) + 1) * self.width // 1000)
        yield pd.DataFrame()

    def _merged(self, a: list, b: list) -> list:
        both = lambda f, x, y: y if x is None else x if y is None else f(x, y)
        first = a[5:7] if list(a[6]) <= list(b[6]) else b[5:7]
        last = a[7:9] if list(a[8]) > list(b[8]) else b[7:9]
        return [a[0] + b[0], a[1] + b[1], both(lambda x, y: x + y, a[2], b[2]), both(min, a[3], b[3]), both(max, a[4], b[4]), *first, *last, [x + y for x, y in zip(a[9], b[9], strict=True)], *self._latest(*(list(x) + list(y) for x, y in zip(a[10:], b[10:], strict=True)))]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Close the buckets that ended by now, in order."""
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        out = []
        for bucket in sorted(k[0] for k in self.open.keys() if (k[0] + 1) * self.width <= until):
            b = list(self.open.getValue((bucket,)))
            self.open.removeKey((bucket,))
            ring = list(self.ring.get()) if self.ring.exists() else [[], [], [], 0.0]
            latest = self._latest(*(list(x) + list(y) for x, y in zip(ring[:3], b[10:], strict=True)))
            total = ring[3] + (b[2] or 0.0)
            self.ring.update((*latest, total))
            first, last = (ring[3], total) if self.counter else (b[5], b[7])
            delta = b[2] if self.counter else None if None in (first, last) else last - first
            out.append((*key, pd.Timestamp(bucket * self.width, unit="us"), *b[:5], first, last, delta, *[bound_at(b[9], q) for q in (0.9, 0.95, 0.99)], nearest(latest[2], self.quantile)))
        yield pd.DataFrame(out, columns=[*self.series, "bucket", *[c.split()[0] for c in FIGURES.split(", ")]])

    def close(self) -> None:
        pass


def drain(samples: DataFrame, tie: str, width: str = "5 seconds", series: tuple[str, ...] = metrics.SERIES, time: str = "ts", counter: bool = False, quantile: float = 0.95, last: int = metrics.RESERVOIR) -> DataFrame:
    """A stream of samples (a watermark on `time`) as buckets that come out when the watermark passes their end: what metrics.drain gives,
    with p90, p95, p99 by the bucket's histogram, and `recent`, the nearest-rank quantile of the series' latest `last` samples up to then.

    tie orders samples of one time. Null values count as samples only. A bucket's state is its figures and `last` samples at most.
    """
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = dict(samples.dtypes)
    out = ", ".join(f"`{s}` {kind[s]}" for s in series) + f", bucket {kind[time]}, {FIGURES}"
    micros = int(pd.Timedelta(width).total_seconds() * 1_000_000)
    return samples.select(*series, time, tie, F.col("value").cast("double").alias("value")).groupBy(*series).transformWithStateInPandas(Drain(series, time, tie, micros, counter, quantile, last), out, "Append", "EventTime")
