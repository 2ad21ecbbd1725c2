"""NetFlow v9: templates are learnt from an exporter's packets and decode what comes after them, or waited for them.

`Exporter` is the state of one exporter packet by packet, as streams keep it (streaming.netflow9). `parse` gives the same rows of a
batch, without bringing an exporter's packets together. Rules of both:

* A restart (uptime and sequence both go back modulo 2^32, the export time doesn't) or a day of silence begins a new epoch: templates, what
  waits and sampling belong to an epoch and end with it.
* Templates are known by kind (data, options) and id; a data template is looked for first. A template is in force for TEMPLATE_TTL_S from when
  it last came, however much it is used. When it has expired, its signature is remembered.
* A flowset without a template in force waits PENDING_S. If a template of its id has expired, it waits for that kind and signature alone: if the
  id comes back with another signature, the flowset is dropped. Otherwise it takes the first template of its id.
* A packet is refused as a whole if any of it is unsound, or if its records aren't as many as its header says. What waits isn't counted, but must
  leave room. Templates that stand before the error in it are learnt.
"""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import running
from ..operators.lineage import cut, drop

# How fields are read, by id; other ids up to 104, and 234 and 235, are numbers.
IPV4 = {8, 12, 15, 18, 44, 45, 47}
IPV6 = {27, 28, 62, 63}
TEXT = {82, 83, 84, 94, 95, 96}
MOST_FIELDS, MOST_RECORD, TEMPLATE_TTL_S, PENDING_S, PENDING_BYTES, MOST_TEMPLATES, IDLE_S = 128, 65535, 3600.0, 30.0, 1 << 20, 1024, 86400.0
DATA, OPTIONS = 0, 1  # kinds of templates, by the flowset that they come in

SCHEMA = """
collector_id string, source_host string, source_ip string, source_id bigint, received_at timestamp, packet_sequence bigint, record_index int,
template_id int, exporter_time timestamp, exporter_uptime_ms bigint, fields map<int,string>, error string, flowset_index int
"""
#: Rows of options records have `scopes` too.
ALL = SCHEMA + ", scopes map<int,string>"
KEYS = ("collector_id", "source_host", "source_ip", "source_id")
_NAMES = [c.split()[0] for c in ALL.strip().replace("\n", " ").replace("<int,string>", "").split(",")]


class Malformed(ValueError):
    """A packet that is refused; its text is the code."""


class Head(NamedTuple):
    sequence: int
    seconds: int
    uptime: int
    count: int


class Found(NamedTuple):
    """A record, or what became of a flowset; head is that of the packet the flowset came in, scopes is set for options."""

    head: Head | None
    index: int | None
    template_id: int | None
    fields: dict[int, str] | None
    error: str | None
    flowset: int | None = None
    scopes: dict[int, str] | None = None


@dataclass(frozen=True)
class Template:
    """Of an options template the first `scopes` fields are scopes."""

    kind: int
    tid: int
    fields: tuple[tuple[int, int], ...]
    scopes: int = 0

    def signature(self) -> str:
        return f"{self.scopes}|" + ",".join(f"{k}:{n}" for k, n in self.fields)


@dataclass(frozen=True)
class Waiting:
    tid: int
    body: bytes
    head: Head
    at: float
    index: int
    flowset: int
    kind: int | None = None  # what it waits for, if a template has expired
    signature: str | None = None


def value(kind: int, raw: bytes, scope: bool = False) -> str:
    if not scope:
        if kind in IPV4 or kind in IPV6:
            if len(raw) != (4 if kind in IPV4 else 16):
                raise Malformed("invalid_field_length")
            return str(ipaddress.ip_address(raw))
        if kind in TEXT:
            try:
                return raw.rstrip(b"\0").decode()
            except UnicodeDecodeError:
                raise Malformed("invalid_string") from None
    if scope or 1 <= kind <= 104 or kind in (234, 235):
        if not 1 <= len(raw) <= 8:
            raise Malformed("invalid_field_length")
        return str(int.from_bytes(raw, "big"))
    return raw.hex()


def header(packet: bytes) -> Head:
    if len(packet) < 20:
        raise Malformed("malformed_packet")
    version, count, uptime, seconds, sequence, _ = struct.unpack(">HHIIII", packet[:20])
    if version != 9:
        raise Malformed("unsupported_version")
    return Head(sequence, seconds, uptime, count)


def flowsets(packet: bytes) -> list[tuple[int, bytes]]:
    at, out = 20, []
    while at < len(packet):
        if len(packet) - at < 4:
            raise Malformed("invalid_flowset_boundary")
        kind, length = struct.unpack(">HH", packet[at : at + 4])
        if length < 4 or at + length > len(packet):
            raise Malformed("invalid_flowset_boundary")
        if 2 <= kind <= 255:
            raise Malformed("invalid_flowset_id")
        out.append((kind, packet[at + 4 : at + length]))
        at += length
    return out


def flowsets_of(packet: bytes) -> tuple[list[tuple[int, bytes]], Head]:
    """Flowsets and head of a packet that is sound so far."""
    head = header(packet)
    return flowsets(packet), head


def templates(kind: int, body: bytes) -> list[Template]:
    """The templates of a data or options template flowset; up to three bytes may be left over."""
    at, out, bad = 0, [], "invalid_template" if kind == DATA else "invalid_options_template"
    head = 4 if kind == DATA else 6
    while len(body) - at > 3:
        if len(body) - at < head:
            raise Malformed(bad)
        if kind == DATA:
            tid, n = struct.unpack(">HH", body[at : at + 4])
            scopes = 0
        else:
            tid, scope_bytes, option_bytes = struct.unpack(">HHH", body[at : at + 6])
            scopes, n = scope_bytes // 4, scope_bytes // 4 + option_bytes // 4
            if tid >= 256 and (scope_bytes % 4 or option_bytes % 4 or not scope_bytes or not option_bytes):
                raise Malformed(bad)
        if tid < 256:
            raise Malformed(bad)
        if not 0 < n <= MOST_FIELDS:
            raise Malformed("template_limit")
        if at + head + 4 * n > len(body):
            raise Malformed(bad)
        out.append(Template(kind, tid, tuple(struct.unpack(">HH", body[at + head + 4 * i : at + head + 4 * i + 4]) for i in range(n)), scopes))
        at += head + 4 * n
    return out


def checked(template: Template) -> Template:
    width = 0
    for _, length in template.fields:
        if length in (0, 0xFFFF):
            raise Malformed("invalid_field_length")
        width += length
        if width > MOST_RECORD:
            raise Malformed("record_limit")
    return template


def records(template: Template, body: bytes) -> list[tuple[dict[int, str] | None, dict[int, str]]]:
    """(scopes or None, fields) of each record of a data flowset. Of fields with one id the first counts."""
    width = sum(length for _, length in template.fields)
    if len(body) < width or len(body) % width > 3:
        raise Malformed("invalid_flowset_length")
    out = []
    for at in range(0, len(body) - width + 1, width):
        scopes, found = {}, {}
        for i, (kind, length) in enumerate(template.fields):
            scope = i < template.scopes
            (scopes if scope else found).setdefault(kind, value(kind, body[at : at + length], scope))
            at += length
        out.append((scopes if template.kind == OPTIONS else None, found))
    return out


def went_back(before: int, now: int) -> bool:
    """Whether a 32-bit counter went back, and not on past its end."""
    return now < before and (now - before) % 2**32 >= 2**31


def restarted(before: Head, now: Head) -> bool:
    return went_back(before.uptime, now.uptime) and went_back(before.sequence, now.sequence) and not went_back(before.seconds, now.seconds)


def sampled(known: dict[str, int], names: MutableMapping[int, str], scopes: dict[int, str], fields: dict[int, str]) -> None:
    """Take what an options record says of sampling (interval, algorithm, sampler) and of the names of interfaces."""
    for scope, name in ((2, "interface"), (5, "sampler")):
        if scope in scopes:
            known[name] = int(scopes[scope])
    for field, content in fields.items():
        if field == 34:
            known["interval"] = int(content)
        elif field in (35, 49):
            known["algorithm"] = int(content)
        elif field == 48:
            known["sampler"] = int(content)
        elif field == 50 and not known.get("interval"):
            known["interval"] = int(content)
        elif field == 82 and known.get("interface"):
            if known["interface"] not in names and len(names) >= MOST_TEMPLATES:
                del names[next(iter(names))]
            names[known["interface"]] = content


class Exporter:
    """One exporter's state, all of it bounded. The mappings are dicts, or what a stream keeps in their stead.

    known: (template, received, generation) by (kind, id). expired: signatures and generations: by (kind, id). waiting: by number of arrival. names:
    interfaces. facts: the last head and time, bytes that wait, the next number, and sampling.
    """

    def __init__(self, known: MutableMapping | None = None, expired: MutableMapping | None = None, waiting: MutableMapping | None = None, names: MutableMapping | None = None, facts: dict | None = None):
        given = lambda mapping: {} if mapping is None else mapping
        self.known, self.expired, self.waiting, self.names, self.facts = given(known), given(expired), given(waiting), given(names), given(facts)
        self.facts.setdefault("sampling", {})

    @property
    def sampling(self) -> dict[str, int]:
        return self.facts["sampling"]

    def learn(self, template: Template, now: float) -> Iterator[Found]:
        """A template, new, again or redefined; then what waited for it. A new signature is a new generation of its kind and id."""
        key = (template.kind, template.tid)
        old = self.known.get(key)
        if old is not None and old[0].signature() == template.signature():
            self.known[key] = (template, now, old[2])
        else:
            before = self.expired.get(key, (None, 0))[1] if old is None else old[2]
            if old is None:
                while len(self.known) >= MOST_TEMPLATES:  # the one that came longest ago
                    self.forget(min(self.known, key=lambda k: (self.known[k][1], k)))
            self.expired.pop(key, None)
            self.known[key] = (template, now, before + 1)
        if self.facts.get("bytes"):
            for number in sorted(n for n, w in self.waiting.items() if w.tid == template.tid and w.kind in (None, template.kind)):
                w = self.take(number)
                if w.signature not in (None, template.signature()):
                    yield Found(w.head, None, w.tid, None, "template_redefined", w.flowset)
                    continue
                try:
                    yield from self.found(template, w.body, w.head, w.index, w.flowset)
                except Malformed:
                    yield Found(w.head, None, w.tid, None, "replay_failed", w.flowset)

    def forget(self, key: tuple[int, int]) -> None:
        """A template goes; its signature stays."""
        template, _, generation = self.known.pop(key)
        if key not in self.expired and len(self.expired) >= MOST_TEMPLATES:
            del self.expired[next(iter(self.expired))]
        self.expired[key] = (template.signature(), generation)

    def take(self, number: int) -> Waiting:
        w = self.waiting.pop(number)
        self.facts["bytes"] -= len(w.body)
        return w

    def found(self, template: Template, body: bytes, head: Head, first: int, flowset: int) -> list[Found]:
        out = [Found(head, first + i, template.tid, fields, None, flowset, scopes) for i, (scopes, fields) in enumerate(records(template, body))]
        for f in out:
            if f.scopes is not None:
                sampled(self.sampling, self.names, f.scopes, f.fields)
        return out

    def drop(self, error: str) -> Iterator[Found]:
        """Forget everything; what waited comes out."""
        for number in sorted(self.waiting):
            w = self.take(number)
            yield Found(w.head, None, w.tid, None, error, w.flowset)
        for mapping in (self.known, self.expired, self.names, self.facts):
            mapping.clear()
        self.facts["sampling"] = {}

    def expire(self, now: float) -> Iterator[Found]:
        for key in [k for k, (_, at, _) in self.known.items() if now >= at + TEMPLATE_TTL_S]:
            self.forget(key)
        if self.facts.get("bytes"):
            for number in sorted(n for n, w in self.waiting.items() if now >= w.at + PENDING_S):
                w = self.take(number)
                yield Found(w.head, None, w.tid, None, "pending_expired", w.flowset)

    def deadline(self) -> float | None:
        """When the first of the waiting flowsets has waited long enough."""
        return min((w.at + PENDING_S for w in self.waiting.values()), default=None) if self.facts.get("bytes") else None

    def fold(self, packet: bytes, now: float) -> Iterator[Found]:
        """What this packet lets decode: first what comes of time and of what waited, then its own records, or one error in their stead.

        Records of a packet are numbered over its flowsets. A flowset that waits keeps its place: it takes as many numbers as it has bytes.
        """
        try:
            sets, head = flowsets_of(packet)
        except Malformed as e:
            yield Found(None, None, None, None, str(e))
            return
        yield from self.expire(now)
        if self.facts.get("seen") is not None and now >= self.facts["seen"] + IDLE_S:
            yield from self.drop("exporter_idle")  # nothing waits any more
        last = self.facts.get("last")
        if last is not None and restarted(last, head):
            yield from self.drop("exporter_restart")
        self.facts["seen"] = now
        own, counted, index, waits = [], 0, 0, False
        try:
            for place, (kind, body) in enumerate(sets):
                if kind <= OPTIONS:
                    learnt = templates(kind, body)
                    for template in learnt:
                        yield from self.learn(checked(template), now)
                    counted += len(learnt)
                    continue
                template = next((self.known[key][0] for key in ((DATA, kind), (OPTIONS, kind)) if key in self.known), None)
                if template is not None:
                    got = self.found(template, body, head, index, place)
                    own += got
                    counted += len(got)
                    index += len(got)
                    continue
                if len(body) > PENDING_BYTES:
                    raise Malformed("pending_limit")
                wanted = next((key for key in ((DATA, kind), (OPTIONS, kind)) if key in self.expired), None)
                waits, number = True, self.facts.get("number", 0)
                self.waiting[number] = Waiting(kind, body, head, now, index, place, wanted and wanted[0], wanted and self.expired[wanted][0])
                self.facts["number"], self.facts["bytes"] = number + 1, self.facts.get("bytes", 0) + len(body)
                index += len(body)
                while self.facts["bytes"] > PENDING_BYTES:
                    w = self.take(min(self.waiting))
                    yield Found(w.head, None, w.tid, None, "pending_evicted", w.flowset)
            if counted > head.count or counted != head.count and not waits or waits and counted >= head.count:
                raise Malformed("invalid_record_count")
        except Malformed as e:
            yield Found(head, None, None, None, str(e))
            return
        self.facts["last"] = head
        yield from own


def _row(key: tuple, at, found: Found) -> tuple:
    head = found.head
    return (*key, at, head and head.sequence, found.index, found.template_id, pd.Timestamp(head.seconds, unit="s") if head else None, head and head.uptime, found.fields, found.error, found.flowset, found.scopes)


def rows(state: Exporter, key: tuple, packets: pd.DataFrame) -> pd.DataFrame:
    """Decoded records of packets (packet, received_at) in their order, as ALL has them."""
    out = []
    for packet, at in zip(packets["packet"], packets["received_at"], strict=True):
        out += [_row(key, at, found) for found in state.fold(bytes(packet or b""), at.timestamp())]
    return pd.DataFrame(out, columns=_NAMES)


def timed_out(state: Exporter, key: tuple, now: float) -> pd.DataFrame:
    """Rows of the flowsets that have waited long enough by `now`, with no packet to bring them out."""
    at = pd.Timestamp(now, unit="s")
    return pd.DataFrame([_row(key, at, found) for found in state.expire(now)], columns=_NAMES)


# Batches. Times are compared as (received_at, arrival, place), place being that of a flowset in its packet; -1 is before the first.

_LEARNT = f"{', '.join(k + (' bigint' if k == 'source_id' else ' string') for k in KEYS)}, received_at timestamp, arrival bigint, place int, kind int, template_id int, ids array<int>, lengths array<int>, scopes int"


def _learnt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The templates that sound packets bring, up to the first error."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            packet = bytes(row.packet or b"")
            try:
                for place, (kind, body) in enumerate(flowsets_of(packet)[0]):
                    if kind <= OPTIONS:
                        for t in templates(kind, body):
                            checked(t)
                            out.append((*row[:4], row.received_at, row.arrival, place, kind, t.tid, [k for k, _ in t.fields], [n for _, n in t.fields], t.scopes))
            except Malformed:  # the pass over data reports it
                continue
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _LEARNT.split(", ")])


_ORDER = ("received_at", "arrival")
_TEMPLATE = ("kind", "template_id", "ids", "lengths", "scopes")


def _number(packet: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(packet, at + 1, 4)), 16, 10).cast("bigint")


def _back(before: Column, now: Column) -> Column:
    return (now < before) & (F.pmod(now - before, F.lit(2**32)) >= 2**31)


def epochs(packets: DataFrame) -> DataFrame:
    """A row for each epoch of an exporter (KEYS, arrival apart): epoch from 0 on, `since` and `until`, the (received_at, arrival) of its first
    packet and of the next one's (null: none), `ended` with the latter's time, and `last`, when the exporter's last packet came."""
    p = F.col("packet")
    sound = packets.where((F.octet_length(p) >= 20) & (F.hex(F.substring(p, 1, 2)) == "0009"))
    heads = sound.select(*KEYS, *_ORDER, _number(p, 4).alias("uptime"), _number(p, 8).alias("seconds"), _number(p, 12).alias("sequence"))
    found = running.previous(heads, KEYS, _ORDER, ("uptime", "seconds", "sequence", "received_at"), "was")
    was = lambda name: F.col(f"was.{name}")
    again = _back(was("uptime"), F.col("uptime")) & _back(was("sequence"), F.col("sequence")) & ~_back(was("seconds"), F.col("seconds"))
    idle = F.col("received_at").cast("double") >= was("received_at").cast("double") + IDLE_S
    starts = found.where(F.col("was").isNull() | again | idle).select(*KEYS, F.struct(*_ORDER).alias("since"))
    w = Window.partitionBy(*KEYS).orderBy("since")  # a row an epoch
    last = packets.groupBy(*KEYS).agg(F.max("received_at").alias("last"))
    return _with(starts.select("*", (F.row_number().over(w) - 1).alias("epoch"), F.lead("since").over(w).alias("until")), last, KEYS, "inner")


def _with(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str, *conditions: Column) -> DataFrame:
    """Join by keys, nulls being equal, and further conditions; right's keys go."""
    named = right.withColumnsRenamed({k: f"its_{k}" for k in keys})
    return left.join(named, [F.col(k).eqNullSafe(F.col(f"its_{k}")) for k in keys] + list(conditions), how).drop(*[f"its_{k}" for k in keys])


def _within(at: Column) -> list[Column]:
    return [F.col("since") <= at, F.col("until").isNull() | (at < F.col("until"))]


def runs(learnt: DataFrame) -> DataFrame:
    """The templates of (KEYS, epoch, kind, template_id) as runs of one signature, never longer than TEMPLATE_TTL_S without it.

    `since` is the (received_at, arrival, place) a run begins at, `until` that of the next one (null: none), `ended` when its template last came.
    A further row with no template reaches from before everything to the first run. `then` is the template of the next run.
    """
    keys = (*KEYS, "epoch", "kind", "template_id")
    at = F.struct("received_at", "arrival", "place")
    meaning = F.struct("kind", "template_id", "ids", "lengths", "scopes")
    told = running.previous(learnt, keys, ("received_at", "arrival", "place"), ("ids", "lengths", "scopes", "received_at"), "was")
    same = (F.col("was.ids") == F.col("ids")) & (F.col("was.lengths") == F.col("lengths")) & (F.col("was.scopes") == F.col("scopes"))
    lived = F.col("received_at").cast("double") < F.col("was.received_at").cast("double") + TEMPLATE_TTL_S
    starts = told.where(~F.coalesce(same & lived, F.lit(False))).select(*keys, at.alias("since"), F.col("was.received_at").alias("before"), meaning.alias("template"))
    last = learnt.groupBy(*keys).agg(F.max("received_at").alias("last"))
    w = Window.partitionBy(*keys).orderBy("since")  # a row a run
    both = _with(starts, last, keys, "inner")
    lead = lambda c: F.lead(c).over(w)
    real = both.select(*keys, "since", lead("since").alias("until"), F.coalesce(lead("before"), "last").alias("ended"), "template", lead("template").alias("then"), F.row_number().over(w).alias("n"))
    first = real.where("n = 1").withColumns({"until": F.col("since"), "then": F.col("template")}).withColumns({"since": F.lit(None).cast(real.schema["since"].dataType), "ended": F.lit(None).cast("timestamp"), "template": F.lit(None).cast(real.schema["template"].dataType)})
    return real.unionByName(first).drop("n")


_SETS = "head struct<sequence: bigint, seconds: bigint, uptime: bigint, count: int>, refused string, sets array<struct<place: int, id: int, body: binary, templates: int>>"


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packets as their flowsets; of an unsound one `refused`. Of template flowsets only the number of templates is kept."""
    for pdf in batches:
        out = []
        for packet in pdf["packet"]:
            packet, head, sets, refused = bytes(packet or b""), None, [], None
            try:
                framed, head = flowsets_of(packet)
                for place, (kind, body) in enumerate(framed):
                    n = len([checked(t) for t in templates(kind, body)]) if kind <= OPTIONS else 0
                    sets.append({"place": place, "id": kind, "body": None if kind <= OPTIONS else body, "templates": n})
            except Malformed as e:
                refused, sets = str(e), []
            out.append((head and head._asdict(), refused, sets))
        yield pd.concat([pdf.drop(columns="packet").reset_index(drop=True), pd.DataFrame(out, columns=["head", "refused", "sets"])], axis=1)


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of packets, each with its flowsets and what its epoch's runs say of them."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            key, head = row[:4], Head(**row.head) if row.head is not None else None
            if row.refused is not None:
                out.append(_row(key, row.received_at, Found(head, None, None, None, row.refused)))
                continue
            own, counted, index, waits = [], 0, 0, False
            try:
                for s in sorted(row.sets, key=lambda s: s["place"]):
                    counted += s["templates"]
                    if s["id"] <= OPTIONS:
                        continue
                    if s["error"] or s["late"]:
                        waits, first = True, index
                        index += len(s["body"])
                        if s["late"]:
                            try:
                                own += [Found(head, first + i, s["id"], f, None, s["place"], scopes) for i, (scopes, f) in enumerate(records(_template(s["template"]), s["body"]))]
                            except Malformed:
                                own.append(Found(head, None, s["id"], None, "replay_failed", s["place"]))
                        elif s["error"] != "waits":
                            own.append(Found(head, None, s["id"], None, s["error"], s["place"]))
                        continue
                    got = records(_template(s["template"]), s["body"])
                    own += [Found(head, index + i, s["id"], f, None, s["place"], scopes) for i, (scopes, f) in enumerate(got)]
                    counted, index = counted + len(got), index + len(got)
                if counted > head.count or counted != head.count and not waits or waits and counted >= head.count:
                    raise Malformed("invalid_record_count")
            except Malformed as e:
                own = [Found(head, None, None, None, str(e))]
            out += [_row(key, row.received_at, f) for f in own]
        yield pd.DataFrame(out, columns=_NAMES)


def _template(t) -> Template:
    return Template(t["kind"], t["template_id"], tuple(zip(t["ids"], t["lengths"], strict=True)), t["scopes"])


#: Epochs and runs up to so many rows go to every task, so that packets stay where they are; more are shuffled with the packets.
FEW = 100_000


def _few(rows: DataFrame) -> DataFrame:
    """rows, which `cut` made, to be broadcast in joins if they are few."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _own(packets: DataFrame) -> DataFrame:
    return packets.select(*KEYS, "packet", "received_at", F.col("arrival").cast("bigint").alias("arrival"))


def decoded(packets: DataFrame) -> DataFrame:
    """`parse` with options records too, which have `scopes`."""
    own = _own(packets)
    return _decode(own, _few(cut(epochs(own))), False)


def _decode(own: DataFrame, begun: DataFrame, options: bool) -> DataFrame:
    """Rows of these packets, which lie in the epochs that have begun; of those only that bring options records, if `options`."""
    learnt = own.mapInPandas(_learnt, _LEARNT)
    learnt = cut(_with(learnt, begun.select(*KEYS, "epoch", "since", "until"), KEYS, "inner", *_within(F.struct(*_ORDER))).drop("since", "until"))
    told = _few(cut(runs(learnt)))
    drop(learnt)

    kept = own.schema
    split = own.select(*[c for c in own.columns if c != "packet"], "packet").mapInPandas(_split, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in kept if f.name != 'packet')}, {_SETS}")
    split = split.withColumn("number", F.monotonically_increasing_id())
    each = split.select("*", F.explode_outer("sets").alias("set")).drop("sets")
    each = _with(each, begun.withColumnRenamed("until", "epoch_until"), KEYS, "left", F.col("since") <= F.struct(*_ORDER), F.col("epoch_until").isNull() | (F.struct(*_ORDER) < F.col("epoch_until"))).drop("since")
    each = each.withColumn("template_id", F.when(F.col("set.id") > OPTIONS, F.col("set.id")))
    keys = (*KEYS, "epoch", "template_id")
    for kind, name in ((DATA, "data"), (OPTIONS, "options")):
        its = told.where(F.col("kind") == kind).select(*keys, "since", "until", F.struct("template", "ended", F.col("until").alias("next"), "then").alias(name))
        at = F.struct("received_at", "arrival", F.col("set.place"))
        each = _with(each, its, keys, "left", F.col("since").isNull() | (F.col("since") <= at), F.col("until").isNull() | (at < F.col("until"))).drop("since", "until")
    each = each.withColumn("what", _decided())
    fields = F.struct(*[F.col(f"set.{c}").alias(c) for c in ("place", "id", "body", "templates")], *[F.col(f"what.{c}").alias(c) for c in ("template", "late", "error")])
    whole = each.groupBy("number").agg(*[F.first(c).alias(c) for c in (*KEYS, "received_at", "head", "refused")], F.collect_list(F.when(F.col("set").isNotNull(), fields)).alias("sets"))
    if options:
        whole = whole.where(F.exists("sets", lambda x: F.coalesce(x["template"]["kind"] == OPTIONS, F.lit(False))))
    return whole.select(*KEYS, "received_at", "head", "refused", "sets").mapInPandas(_decoded, ALL)


def _decided() -> Column:
    """What becomes of a flowset: its template, whether that came late, or an error; `waits` if nothing is known yet."""
    seconds = lambda c: c.cast("double")
    at = seconds(F.col("received_at"))
    template = lambda kind: F.col(f"{kind}.template")
    valid = lambda kind: template(kind).isNotNull() & (at < seconds(F.col(f"{kind}.ended")) + TEMPLATE_TTL_S)
    coming = lambda kind: F.col(f"{kind}.then").isNotNull() & (seconds(F.col(f"{kind}.next.received_at")) < at + PENDING_S)
    same = lambda kind: F.to_json(template(kind)) == F.to_json(F.col(f"{kind}.then"))
    none = F.lit(None).cast("struct<kind: int, template_id: int, ids: array<int>, lengths: array<int>, scopes: int>")
    what = lambda t=none, late=False, error=None: F.struct(t.alias("template"), F.lit(late).alias("late"), F.lit(error).cast("string").alias("error"))
    out = F.when(F.col("set.id") <= OPTIONS, what()).when(valid("data"), what(template("data"))).when(valid("options"), what(template("options")))
    for kind in ("data", "options"):  # one that has expired is waited for, and no other
        gone = template(kind).isNotNull()
        out = out.when(gone & coming(kind) & same(kind), what(F.col(f"{kind}.then"), True)).when(gone & coming(kind), what(error="template_redefined"))
        out = out.when(gone, _given_up(at))
    sooner = ~coming("options") | (F.col("data.next") < F.col("options.next"))
    out = out.when(coming("data") & sooner, what(F.col("data.then"), True)).when(coming("options"), what(F.col("options.then"), True))
    return out.otherwise(_given_up(at))


def _given_up(at: Column) -> Column:
    """A flowset that no template came for: it ends with its epoch, or by time, or still waits when the batch ends."""
    none = F.lit(None).cast("struct<kind: int, template_id: int, ids: array<int>, lengths: array<int>, scopes: int>")
    restart = F.col("epoch_until.received_at").cast("double") < at + PENDING_S
    error = F.when(restart, "exporter_restart").when(F.col("last").cast("double") >= at + PENDING_S, "pending_expired").otherwise("waits")
    return F.struct(none.alias("template"), F.lit(False).alias("late"), error.alias("error"))


def parse(packets: DataFrame) -> DataFrame:
    """Batch form: packets (KEYS, packet, received_at, arrival) decoded by the rules above, as SCHEMA has them.

    No exporter's packets come together. Heads become epochs and templates become runs, by windows over spans of time; both are few. A
    packet's flowsets are joined with the run that each of them lies in, and meet again by the packet's number, so that it can be
    refused as a whole. Epochs and runs are written to the checkpoint folder when this is called. `arrival` tells packets of one time apart; `received_at` of a row is that of its own packet.

    Two things are decided without regard to what a packet's data decode to: a packet that is refused for its records still counts for
    restarts, and templates behind its error are learnt. What waits when the batch ends gives no row; caps on templates and
    waiting bytes, which streams have, aren't needed here.
    """
    return decoded(packets).where("scopes is null").drop("scopes")


def sampling(packets: DataFrame) -> DataFrame:
    """What options records say in the end: KEYS, interval, algorithm, sampler, interfaces (a map of names by interface).

    The last word counts, by time and place in the packet; a random interval (50) only where there is no other. An epoch's words end with it, so
    only the last epoch of an exporter speaks.
    """
    own = _own(packets)
    latest = _few(cut(epochs(own).where("until is null")))
    current = _with(own, latest.select(*KEYS, "since"), KEYS, "inner", F.struct(*_ORDER) >= F.col("since")).drop("since")
    said = _decode(current, latest, True).where("scopes is not null")
    order = F.struct("received_at", "packet_sequence", "record_index")
    get = lambda c, k: F.try_element_at(c, F.lit(k)).cast("bigint")
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), order))
    fields, scopes = F.col("fields"), F.col("scopes")
    name = F.try_element_at(fields, F.lit(82))
    interface = get(scopes, 2)
    one = said.groupBy(*KEYS).agg(
        F.coalesce(last(get(fields, 34)), last(get(fields, 50))).alias("interval"), last(F.coalesce(get(fields, 49), get(fields, 35))).alias("algorithm"),
        last(F.coalesce(get(fields, 48), get(scopes, 5))).alias("sampler"))
    named = said.where(name.isNotNull() & (interface > 0)).groupBy(*KEYS, interface.alias("interface")).agg(F.max_by(name, order).alias("name"))
    names = named.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("interface", "name"))).alias("interfaces"))
    return _with(one, names, KEYS, "left")
