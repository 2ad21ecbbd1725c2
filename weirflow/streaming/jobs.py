"""Streaming forms: the batch functions inside foreachBatch, and NetFlow v9 with its templates as state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import normalize, store, tiers
from . import netflow9


def ingest(stream: DataFrame, normalizer, flows_path: str, letters_path: str, checkpoint: str, tiers_path: str | None = None, partial: bool = False, **trigger) -> StreamingQuery:
    """Normalize a stream of records, append sound flows, set bad ones aside and refresh the tiers of touched days.

    With `partial`, tiers_path is one of operators.tiers: a batch only notes the partial sums of its own new flows, before they are appended, and
    tiers.fold takes them up when it is run.

    Delivery is at least once and the append drops what it has seen, so a batch that runs again adds nothing. normalizer is one
    of operators.normalize; trigger goes to writeStream.trigger (by default, all that is there).
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = normalizer(batch).persist()
        try:
            flows, letters = normalize.split(done)
            store.append(flows, flows_path, (lambda new: tiers.note(new, tiers_path, number)) if tiers_path and partial else None)
            letters.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(letters_path)
            if partial:
                return
            days = [r[0] for r in flows.select(F.to_date("event_start_time")).distinct().collect()]
            if tiers_path and days:
                store.refresh(spark, flows_path, tiers_path, days)
        finally:
            done.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def decode_netflow9(packets: DataFrame, idle: str = "24 hours") -> DataFrame:
    """A stream of packets (netflow9.KEYS, packet, received_at) decoded; templates, waiting flowsets and sampling are state (streaming.netflow9).

    What has waited long enough comes out as an error by a timer; an exporter that is silent for `idle` is forgotten.
    """
    return netflow9.decode(packets, idle)


class Lag(StreamingQueryListener):
    """What each query was behind at its last progress: `behind` has (rows in, rows in a second, rows done in a second, seconds to catch up) by name or id."""

    def __init__(self):
        self.behind: dict[str, tuple[int, float, float, float | None]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        rows, came, done = p.numInputRows, p.inputRowsPerSecond or 0.0, p.processedRowsPerSecond or 0.0
        self.behind[p.name or str(p.id)] = (rows, came, done, rows / done if done else None)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.behind.pop(str(event.id), None)
