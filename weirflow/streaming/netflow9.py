"""A stream of NetFlow v9 packets decoded, with each exporter's templates, waiting flowsets and sampling as keyed state.

State lies in RocksDB entry by entry: a batch reads the entries that its packets ask for and writes those that changed, whatever else an
exporter has there. Entries that nothing has written for `idle` go by their TTL; a timer brings out what has waited long enough
after an exporter fell silent.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import netflow9 as v9

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_GONE = object()


class Kept(MutableMapping):
    """A map state as a mapping. Entries are read when they are asked for, all of them only to iterate, and written by `flush` if they changed."""

    def __init__(self, state, key: tuple[Callable, Callable], value: tuple[Callable, Callable]):
        self.state, (self.to_key, self.from_key), (self.to_value, self.from_value) = state, key, value
        self.read, self.changed, self.whole = {}, {}, False

    def __getitem__(self, key):
        if key not in self.read:
            found = None if self.whole else self.state.getValue(self.to_key(key))
            self.read[key] = _GONE if found is None else self.from_value(found)
        if self.read[key] is _GONE:
            raise KeyError(key)
        return self.read[key]

    def __setitem__(self, key, value) -> None:
        self.read[key] = value
        self.changed[key] = True

    def __delitem__(self, key) -> None:
        self[key]
        self[key] = _GONE

    def __iter__(self):
        if not self.whole:
            for key, value in self.state.iterator():
                self.read.setdefault(self.from_key(key), self.from_value(value))
            self.whole = True
        return iter([k for k, v in self.read.items() if v is not _GONE])

    def __len__(self) -> int:
        return sum(1 for _ in self)

    def flush(self) -> None:
        for key in self.changed:
            if self.read[key] is not _GONE:
                self.state.updateValue(self.to_key(key), self.to_value(self.read[key]))
            elif self.state.containsKey(self.to_key(key)):
                self.state.removeKey(self.to_key(key))


def _template_of(key: tuple, ids, lengths, scopes: int) -> v9.Template:
    return v9.Template(*key, tuple(zip(ids, lengths, strict=True)), scopes)


_BY_KIND = (lambda k: k, lambda k: (k[0], k[1]))
_BY_NUMBER = (lambda n: (n,), lambda k: k[0])


class Processor(StatefulProcessor):
    """idle and wait in milliseconds."""

    def __init__(self, idle: int, wait: int):
        self.idle, self.wait = idle, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        kind = "kind int, template_id int"
        self.facts = handle.getValueState("facts", "sequence bigint, seconds bigint, uptime bigint, count int, seen double, bytes bigint, number bigint, sampling string", self.idle)
        self.known = handle.getMapState("templates", kind, "ids array<int>, lengths array<int>, scopes int, kind int, template_id int, at double, generation bigint", self.idle)
        self.expired = handle.getMapState("expired", kind, "signature string, generation bigint", self.idle)
        self.waiting = handle.getMapState("waiting", "number bigint", "template_id int, body binary, sequence bigint, seconds bigint, uptime bigint, count int, at double, record int, flowset int, kind int, signature string", self.idle)
        self.names = handle.getMapState("interfaces", "interface bigint", "name string", self.idle)

    def _exporter(self) -> v9.Exporter:
        template = (lambda v: ([k for k, _ in v[0].fields], [n for _, n in v[0].fields], v[0].scopes, v[0].kind, v[0].tid, v[1], v[2]), lambda r: (_template_of((r[3], r[4]), r[0], r[1], r[2]), r[5], r[6]))
        waits = (lambda w: (w.tid, w.body, *w.head, w.at, w.index, w.flowset, w.kind, w.signature), lambda r: v9.Waiting(r[0], bytes(r[1]), v9.Head(*r[2:6]), *r[6:]))
        maps = [Kept(self.known, _BY_KIND, template), Kept(self.expired, _BY_KIND, (tuple, tuple)), Kept(self.waiting, _BY_NUMBER, waits), Kept(self.names, _BY_NUMBER, (lambda n: (n,), lambda r: r[0]))]
        facts, own = self.facts.get() if self.facts.exists() else None, {}
        if facts is not None:
            last = None if facts[0] is None else v9.Head(*facts[:4])
            own = {k: v for k, v in {"last": last, "seen": facts[4], "bytes": facts[5], "number": facts[6]}.items() if v is not None} | {"sampling": json.loads(facts[7])}
        return v9.Exporter(*maps, own)

    def _keep(self, exporter: v9.Exporter, now: int) -> None:
        for kept in (exporter.known, exporter.expired, exporter.waiting, exporter.names):
            kept.flush()
        f = exporter.facts
        self.facts.update((*(f.get("last") or (None,) * 4), f.get("seen"), f.get("bytes"), f.get("number"), json.dumps(f["sampling"])))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if f.get("bytes"):
            self.handle.registerTimer(now + self.wait)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        exporter = self._exporter()
        packets = pd.concat(list(rows))  # one exporter's packets of one batch
        yield v9.rows(exporter, key, packets.sort_values([c for c in ("received_at", "arrival") if c in packets], kind="stable"))
        self._keep(exporter, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        exporter = self._exporter()
        late = max((w.at for w in exporter.waiting.values()), default=None)
        if late is not None:  # by the clock of the packets, all of them have waited since the last one came
            yield v9.timed_out(exporter, key, late + v9.PENDING_S)
        self._keep(exporter, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def decode(packets: DataFrame, idle: str = "24 hours", options: bool = False) -> DataFrame:
    """A stream of packets (v9.KEYS, packet, received_at, and arrival where packets of one time need an order) decoded, as v9.SCHEMA has it.

    With `options`, options records come too, and have `scopes`. Packets of one batch are taken by time; those of a later batch are later,
    whatever their time. Caps on templates and waiting bytes hold per exporter. Sets the session's state store to RocksDB, which such state
    needs, for queries started from now on.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    silent = int(pd.Timedelta(idle).total_seconds() * 1000)
    found = packets.groupBy(*v9.KEYS).transformWithStateInPandas(Processor(silent, int(v9.PENDING_S * 1000) + 1000), v9.ALL, "Append", "ProcessingTime")
    return found if options else found.where("scopes is null").drop("scopes")
