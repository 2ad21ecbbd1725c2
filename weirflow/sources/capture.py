"""Capture files (pcap) of many datagrams as a data source, batch and stream: ``spark.read.format("capture")`` after `register`.

Files are read in stretches of bytes, each by a task of its own. A datagram belongs to the stretch that its last byte lies in. Where a stretch
begins within a file, its first record is found by its header: a place from which LINKED headers follow each other without a flaw,
or as many as there are up to the end. A stream's offset is how many bytes of each file have been read; files may grow, and a record
that isn't whole yet is read when it is.

`decode` sends datagrams to decoders by their first number; DECODERS may be extended.
"""

from __future__ import annotations

import socket
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "packet binary, received_at timestamp, source_ip string, source_port int, port int, path string, position bigint"
SPLIT_BYTES, LINKED, BATCH = 64 << 20, 16, 10_000
# Fixed values of the format: magic numbers with the parts of a second, and how what is captured begins.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
ETHERNET, RAW = 1, 101
HEAD, RECORD, MOST_RECORD = 24, 16, 262_144


def _files(path: str) -> list[tuple[str, int]]:
    """(URI, bytes) of a file, or of all files below a folder, in order of name."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    info = fs.get_file_info(at)
    found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(at, recursive=True, allow_not_found=True))
    lead = path[: path.index(at)] if "://" in path and at in path else ""
    return sorted((lead + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith((".", "_")))


def _open(path: str) -> pa.NativeFile:
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    return fs.open_input_file(at)


class Stretch(InputPartition):
    """The records of a file whose last bytes lie in (start, end]."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


def stretches(path: str, start: int, end: int, split: int) -> list[Stretch]:
    cuts = [*range(start, end, split), end]
    return [Stretch(path, a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > HEAD]


class Format:
    """Byte order, parts of a microsecond, longest record and link type of a file, by its first 24 bytes."""

    def __init__(self, head: bytes):
        if len(head) < HEAD or head[:4] not in MAGIC:
            raise ValueError("not a capture file")
        self.order, self.parts = MAGIC[head[:4]]
        most, self.link = struct.unpack(self.order + "II", head[16:24])
        self.most = min(most or MOST_RECORD, MOST_RECORD)
        self.fields = struct.Struct(self.order + "IIII")

    def length(self, data: memoryview, at: int) -> int | None:
        """Bytes of the record that begins there, or None if none does."""
        _, part, kept, whole = self.fields.unpack_from(data, at)
        return RECORD + kept if part < 1_000_000 * self.parts and kept <= whole and kept <= self.most and whole <= 1 << 24 else None

    def begins(self, data: memoryview, at: int, ended: bool) -> bool:
        """Whether headers follow each other from there, LINKED of them or up to the end of the file."""
        for _ in range(LINKED):
            if at == len(data):
                return ended
            if at + RECORD > len(data):
                return ended
            length = self.length(data, at)
            if length is None:
                return False
            at += length
            if at > len(data):
                return ended or at - len(data) <= self.most
        return True


def datagram(frame: bytes, link: int) -> tuple[bytes, str, int, int] | None:
    """(payload, source address, source port, port) of a UDP datagram in a frame; None for anything else, and for later fragments."""
    if link == ETHERNET:
        kind, at = frame[12:14], 14
        while kind in (b"\x81\x00", b"\x88\xa8"):
            kind, at = frame[at + 2 : at + 4], at + 4
        if kind not in (b"\x08\x00", b"\x86\xdd"):
            return None
        frame = frame[at:]
    elif link != RAW:
        return None
    if not frame:
        return None
    if frame[0] >> 4 == 4:
        head = (frame[0] & 15) * 4
        if len(frame) < head + 8 or frame[9] != 17 or int.from_bytes(frame[6:8], "big") & 0x1FFF:
            return None
        source, udp = socket.inet_ntop(socket.AF_INET, frame[12:16]), frame[head:]
    elif frame[0] >> 4 == 6 and len(frame) >= 48 and frame[6] == 17:
        source, udp = socket.inet_ntop(socket.AF_INET6, frame[8:24]), frame[40:]
    else:
        return None
    sender, port, length, _ = struct.unpack(">HHHH", udp[:8])
    return udp[8 : max(8, length)], source, sender, port


def records(stretch: Stretch) -> Iterator[tuple[int, int, bytes, int]]:
    """(position, microseconds, frame, link type) of the whole records of a stretch."""
    with _open(stretch.path) as file:
        form = Format(file.read_at(HEAD, 0))
        size = file.size()
        reach = form.most + RECORD
        # The first record that may end here begins at most `reach` before; headers are looked for from there on.
        begin = max(HEAD, stretch.start - reach)
        data = memoryview(file.read_at(min(size, stretch.end) - begin, begin))
        at = 0
        if begin > HEAD:
            more = memoryview(file.read_at(min(size - begin, len(data) + LINKED * reach), begin))
            ended = begin + len(more) >= size
            while at + RECORD <= len(data) and not (form.length(more, at) is not None and form.begins(more, at, ended)):
                at += 1
        while at + RECORD <= len(data):
            length = form.length(data, at)
            if length is None:
                raise ValueError(f"{stretch.path} has no record at {begin + at}")
            if at + length > len(data):
                return
            if begin + at + length > stretch.start:
                seconds, part, _, _ = form.fields.unpack_from(data, at)
                yield begin + at, seconds * 1_000_000 + part // form.parts, bytes(data[at + RECORD : at + length]), form.link
            at += length


def _batches(stretch: Stretch, port: int | None) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary(), pa.timestamp("us", "UTC"), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for position, micros, frame, link in records(stretch):
        found = datagram(frame, link)
        if found is None or port is not None and found[3] != port:
            continue
        rows.append((found[0], micros, *found[1:], stretch.path, position))
        if len(rows) == BATCH:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("splitbytes", SPLIT_BYTES))
        self.port = int(options["port"]) if "port" in options else None

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return _batches(partition, self.port)


class CaptureReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Stretch]:
        return [s for path, size in _files(self.path) for s in stretches(path, 0, size, self.split)]


class CaptureStream(_Reader, DataSourceStreamReader):
    """Offsets are bytes read by file."""

    def initialOffset(self) -> dict:  # noqa: N802  Spark's names
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        return dict(_files(self.path))

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [s for path, size in end.items() if size > start.get(path, 0) for s in stretches(path, start.get(path, 0), size, self.split)]

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class Capture(DataSource):
    """Options: path (a file, or a folder with all files below; any file system that pyarrow knows by URI), splitBytes, port (of arrival)."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CaptureReader:
        return CaptureReader(self.options)

    def streamReader(self, schema) -> CaptureStream:  # noqa: N802
        return CaptureStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Capture)


#: By first number: the kind of packet that a collector must have, and its decoder from packets to (decoded, rejected).
DECODERS: dict[int, tuple[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]]] = {}


def _netflow5(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    from . import netflow5

    return netflow5.parse(packets)


def _netflow9(packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    from . import netflow9

    number = F.conv(F.hex(F.substring("packet", 17, 4)), 16, 10).cast("bigint")
    found = netflow9.parse(packets.withColumns({"source_id": F.coalesce(number, F.lit(0)), "arrival": F.coalesce("position", F.lit(0))}))
    return found.where("error is null"), found.where("error is not null")


DECODERS |= {5: ("netflow_v5", _netflow5), 9: ("netflow_v9", _netflow9)}


def admitted(packets: DataFrame, collectors: dict[int, str], allowed: tuple[str, ...]) -> DataFrame:
    """packets with `first_number`, `collector_id` and `error`: the first rule that a packet breaks.

    collectors: by first number, which collector takes it; allowed: those that the sender may use. Both are a deployment's few settings.
    """
    size = F.octet_length("packet")
    number = F.conv(F.hex(F.substring("packet", 1, 2)), 16, 10).cast("int")
    collector = F.lit(None).cast("string")
    for k, name in collectors.items():
        if k not in DECODERS:
            raise ValueError(f"no decoder for {k}")
        collector = F.when(number == k, name).otherwise(collector)
    error = F.when(F.coalesce(size < 2, F.lit(True)), "malformed_packet").when(size > 65535, "packet_too_large").when(collector.isNull(), "unsupported_version")
    return packets.withColumns({"first_number": F.when(size >= 2, number), "collector_id": collector, "error": error.when(~collector.isin(*allowed), "unauthorized_collector")})


def decode(packets: DataFrame, collectors: dict[int, str], allowed: tuple[str, ...]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """By kind, (decoded, rejected) of the admitted packets; `refused` has (nothing, those that weren't admitted)."""
    known = admitted(packets, collectors, allowed)
    sound = known.where("error is null").drop("error")
    out = {DECODERS[k][0]: DECODERS[k][1](sound.where(F.col("first_number") == k)) for k in collectors}
    return out | {"refused": (sound.limit(0), known.where("error is not null"))}
