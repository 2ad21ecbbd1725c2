"""Tiers that are kept up by what is new: partial sums of each batch, folded into the tiers' days now and then.

`note` writes a batch's partial sums, a folder of its own for each batch, so that a batch that runs again writes nothing twice. A tier is what its
days hold and what no fold has taken up yet; sums of sums are the tier's, so `current` needs no flows. `fold` writes those days anew that
batches touched, each under the number of the fold, and then one small file, `_current`, that names the days' numbers and the batches
within: with it the fold has happened, before it nothing has. One folder at a time may fold: it holds a lease, which others may take when it
has run out.

Below a path: <tier>/late/batch=<id>/..., <tier>/days/event_date=<day>/fold=<n>/..., _current, _lease.
"""

from __future__ import annotations

import json
import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .flows import PORTS, TALKERS, tier

#: kind and width of each tier; the wide ones come of the narrow ones' partial sums.
TIERS = {"talkers": TALKERS, "ports": PORTS}
WIDTHS = ("5m", "1h")
SUMS = ("total_bytes", "total_packets", "flow_count")
LEASE_S = 900.0
#: Files of a day's tier.
WRITERS = 8


class Held(RuntimeError):
    """Another folder holds the lease."""


class _Folder:
    """Small files below a path, in whatever file system it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.path = path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.exists(name) else []

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that isn't there; False if it is."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:  # noqa: BLE001  py4j wraps it
            if "exists" in str(e).lower():
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """Put a file in another's place at once."""
        made = f"{name}.{uuid.uuid4().hex}"
        self.create(made, text)
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._path(made), self._path(name), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _name(kind: str, width: str) -> str:
    return f"{kind}_{width}"


def _summed(rows: DataFrame, keys: tuple[str, ...], width: str | None = None) -> DataFrame:
    at = F.col("bucket") if width is None else F.date_trunc("hour", "bucket")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("bigint").alias(c)
    return rows.groupBy(at.alias("bucket"), *keys).agg(*map(total, SUMS))


def _state(folder: _Folder) -> dict:
    """fold: the last one's number; days: the fold that each day's rows are of; folded batches: those numbered up to `upto`, and `others`."""
    text = folder.read("_current")
    return json.loads(text) if text else {"fold": 0, "days": {}, "upto": -1, "others": []}


def _folded(state: dict, batch: str) -> bool:
    return batch.isdigit() and int(batch) <= state["upto"] or batch in state["others"]


def _with(state: dict, batches: set[str]) -> dict:
    """The folded batches with some more, numbers without a gap as one."""
    upto, others = state["upto"], set(state["others"]) | batches
    while str(upto + 1) in others:
        upto += 1
        others.remove(str(upto))
    return {"upto": upto, "others": sorted(others)}


def note(fresh: DataFrame, path: str, batch: str | int) -> None:
    """Write the partial sums of a batch's new flows for all tiers; a batch that has been noted or folded is left as it is.

    Flows are read once for each kind of tier; the hourly sums come of the five-minute ones.
    """
    folder, batch = _Folder(fresh.sparkSession, path), str(batch)
    if _folded(_state(folder), batch):
        return
    for kind, keys in TIERS.items():
        narrow = tier(fresh, "5m", keys).persist()
        try:
            for width in WIDTHS:
                name = f"{_name(kind, width)}/late/batch={batch}"
                if not folder.exists(f"{name}/_SUCCESS"):
                    sums = narrow if width == "5m" else _summed(narrow, keys, width)
                    sums.write.mode("overwrite").parquet(f"{folder.path}/{name}")
        finally:
            narrow.unpersist()


def _late(spark: SparkSession, folder: _Folder, name: str, state: dict) -> list[str]:
    """Batches that are whole and not folded yet."""
    return sorted(b for b in (n.removeprefix("batch=") for n in folder.names(f"{name}/late")) if not _folded(state, b) and folder.exists(f"{name}/late/batch={b}/_SUCCESS"))


def _stored(spark: SparkSession, folder: _Folder, name: str, days: dict[str, int], late: list[str]) -> DataFrame | None:
    paths = [f"{folder.path}/{name}/days/event_date={day}/fold={n}" for day, n in sorted(days.items())] + [f"{folder.path}/{name}/late/batch={b}" for b in late]
    return spark.read.parquet(*paths).withColumn("event_date", F.to_date("bucket")) if paths else None


def current(spark: SparkSession, path: str, kind: str, width: str, days: list | None = None) -> DataFrame | None:
    """A tier as it is now (bucket, keys, sums), all of it or some days; None if nothing was noted yet."""
    folder, name = _Folder(spark, path), _name(kind, width)
    state = _state(folder)
    wanted = None if days is None else {str(d) for d in days}
    own = {d: n for d, n in state["days"].items() if wanted is None or d in wanted}
    rows = _stored(spark, folder, name, own, _late(spark, folder, name, state))
    if rows is None:
        return None
    rows = rows if wanted is None else rows.where(F.col("event_date").cast("string").isin(*wanted))
    return _summed(rows, TIERS[kind])


def _lease(folder: _Folder, holder: str, now: float) -> None:
    mine = json.dumps({"holder": holder, "until": now + LEASE_S})
    if folder.create("_lease", mine):
        return
    held = json.loads(folder.read("_lease") or "{}")
    if held.get("holder") != holder and held.get("until", 0) > now:
        raise Held(f"held by {held.get('holder')}")
    folder.replace("_lease", mine)
    if json.loads(folder.read("_lease") or "{}").get("holder") != holder:  # another one took it at the same time
        raise Held("taken by another")


def fold(spark: SparkSession, path: str, holder: str | None = None, now: float | None = None) -> list[str]:
    """Fold noted batches into the days that they touch; returns those days. Raises Held while another holder folds.

    Days that no batch touched aren't read or written. A fold that fails before its end leaves all as it was; what it wrote is overwritten or
    deleted by the next.
    """
    folder, holder = _Folder(spark, path), holder or uuid.uuid4().hex
    _lease(folder, holder, time.time() if now is None else now)
    try:
        state = _state(folder)
        number, taken, touched = state["fold"] + 1, set(), set()
        names = [(kind, width) for kind in TIERS for width in WIDTHS]
        late = {n: _late(spark, folder, _name(*n), state) for n in names}
        whole = set.intersection(*map(set, late.values()))  # batches that all tiers have
        for kind, width in names:
            name, batches = _name(kind, width), sorted(whole)
            rows = _stored(spark, folder, name, {}, batches)
            if rows is None:
                continue
            own = [str(r[0]) for r in rows.select("event_date").distinct().collect()]
            there = _stored(spark, folder, name, {d: n for d, n in state["days"].items() if d in own}, batches)
            done = _summed(there, TIERS[kind]).withColumn("event_date", F.to_date("bucket"))
            done = done.withColumn("fold", F.lit(number)).repartition(F.col("event_date"), F.pmod(F.xxhash64(*TIERS[kind]), F.lit(WRITERS)))
            done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "fold").parquet(f"{folder.path}/{name}/days")
            taken |= set(batches)
            touched |= set(own)
        if touched:
            old = {d: state["days"].get(d) for d in touched}
            days = state["days"] | dict.fromkeys(sorted(touched), number)
            folder.replace("_current", json.dumps({"fold": number, "days": days} | _with(state, taken)))
            for kind, width in names:  # from here on nobody needs them
                for b in taken:
                    folder.delete(f"{_name(kind, width)}/late/batch={b}")
                for d, n in old.items():
                    if n is not None:
                        folder.delete(f"{_name(kind, width)}/days/event_date={d}/fold={n}")
        return sorted(touched)
    finally:
        if json.loads(folder.read("_lease") or "{}").get("holder") == holder:
            folder.delete("_lease")


def due(spark: SparkSession, path: str, now: datetime) -> dict[str, int]:
    """Batches that wait to be folded, by tier."""
    folder = _Folder(spark, path)
    state = _state(folder)
    return {_name(k, w): len(_late(spark, folder, _name(k, w), state)) for k in TIERS for w in WIDTHS}
