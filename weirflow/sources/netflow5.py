"""NetFlow v5 datagrams, decoded with built-in functions alone: a header of 24 bytes and up to 30 records of 48."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flow import first_error, unused
from ..operators import running

HEADER, RECORD, MOST_RECORDS = 24, 48, 30


def number(data: Column, at: int | Column, size: int) -> Column:
    """An unsigned big-endian number of `size` bytes at a 0-based offset."""
    start = at + 1 if isinstance(at, Column) else F.lit(at + 1)
    return F.conv(F.hex(F.substring(data, start, F.lit(size))), 16, 10).cast("bigint")


def words(data: Column, at: Column, count: int) -> Column:
    """`count` numbers of four bytes each, from a 0-based offset on."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: number(data, at + i * 4, 4))


def part(word: Column, at: int, size: int) -> Column:
    """`size` bytes of a number of four bytes, at a 0-based offset in it."""
    return F.shiftright(word, 8 * (4 - at - size)).bitwiseAND((1 << 8 * size) - 1)


def dotted(word: Column) -> Column:
    return F.concat_ws(".", *[part(word, i, 1).cast("string") for i in range(4)])


def parse(packets: DataFrame, column: str = "packet") -> tuple[DataFrame, DataFrame]:
    """(records, rejected): one row with a struct `v5` for each record of sound packets; the others with `error`.

    Each four bytes are read once and fields are cut out of them. Columns named v5 and error are replaced.
    """
    data = F.col(column)
    count = number(data, 2, 2)
    error = first_error(
        (data.isNull() | (F.octet_length(data) < HEADER), "invalid_packet"),
        (number(data, 0, 2) != 5, "unsupported_version"),
        (~count.between(1, MOST_RECORDS) | (F.octet_length(data) != HEADER + count * RECORD), "invalid_packet"),
        (number(data, 12, 4) >= 1_000_000_000, "invalid_packet"),
    )
    checked = packets.withColumn("error", error)
    sound = checked.where("error is null").drop("error")
    i, head, body = (unused(sound, name) for name in ("_i", "_head", "_body"))
    rows = sound.withColumn(head, words(data, F.lit(0), HEADER // 4)).withColumn(i, F.explode(F.sequence(F.lit(0), F.get(head, 0).bitwiseAND(0xFFFF).cast("int") - 1)))
    base = F.col(i) * RECORD + HEADER
    rows = rows.withColumn(body, words(data, base, RECORD // 4))
    h, w = (lambda n: F.get(head, n)), (lambda n: F.get(body, n))
    micros = h(2) * 1_000_000 + F.floor(h(3) / 1000)
    v5 = F.struct(
        h(4).alias("packet_sequence"), F.col(i).alias("record_index"), dotted(w(0)).alias("src_addr"), dotted(w(1)).alias("dst_addr"), dotted(w(2)).alias("next_hop"),
        part(w(3), 0, 2).alias("input_interface"), part(w(3), 2, 2).alias("output_interface"), w(4).alias("packets"), w(5).alias("bytes"),
        w(6).alias("first_switched_ms"), w(7).alias("last_switched_ms"), F.timestamp_micros(micros).alias("exporter_time"), h(1).alias("exporter_uptime_ms"),
        part(w(8), 0, 2).alias("src_port"), part(w(8), 2, 2).alias("dst_port"), part(w(9), 1, 1).alias("tcp_flags"), part(w(9), 2, 1).alias("protocol_number"), part(w(9), 3, 1).alias("tos"),
        part(w(10), 0, 2).alias("src_as"), part(w(10), 2, 2).alias("dst_as"), part(w(11), 0, 1).alias("src_mask"), part(w(11), 1, 1).alias("dst_mask"),
        part(h(5), 0, 1).alias("engine_type"), part(h(5), 1, 1).alias("engine_id"), h(5).bitwiseAND(0x3FFF).alias("sampling_rate"),
        F.substring(data, base + 1, F.lit(4)).alias("src_key"), F.substring(data, base + 5, F.lit(4)).alias("dst_key"),
    )
    return rows.withColumn("v5", v5).drop(i, head, body), checked.where("error is not null")


def route(packets: DataFrame, column: str = "packet") -> DataFrame:
    """packets with `kind`: netflow_v5, netflow_v9 or, by size or first two bytes, unknown."""
    data = F.col(column)
    v = number(data, 0, 2)
    sized = F.octet_length(data).between(2, 65535)
    return packets.withColumn("kind", F.when(sized & (v == 5), "netflow_v5").when(sized & (v == 9), "netflow_v9").otherwise("unknown"))


def _before(packets: DataFrame, exporter: str, order: tuple[str, ...], columns: tuple[str, ...], to: str) -> DataFrame:
    """packets with those columns of the exporter's packet before: by spans of time in a batch, by state in a stream."""
    if packets.isStreaming:
        from ..streaming import series

        return series.previous(packets, (exporter,), order, columns, to)
    return running.previous(packets, (exporter,), order, columns, to)


def gaps(packets: DataFrame, exporter: str = "source_ip", sequence: str = "sequence", records: str = "records", order: tuple[str, ...] = ("received_at",)) -> DataFrame:
    """packets, of a batch or a stream, with `expected` (previous sequence and records, modulo 2^32) and `lost`, 0 for an exporter's first packet.

    order begins with a time or a number of seconds. No window spans an exporter's history.
    """
    was = unused(packets, "_was")
    found = _before(packets, exporter, order, (sequence, records), was)
    expected = F.pmod(F.col(f"{was}.{sequence}") + F.col(f"{was}.{records}"), F.lit(2**32))
    return found.withColumn("expected", expected).withColumn("lost", F.coalesce(F.pmod(F.col(sequence) - F.col("expected"), F.lit(2**32)), F.lit(0))).drop(was)


def restarts(packets: DataFrame, exporter: str = "source_ip", order: tuple[str, ...] = ("received_at",)) -> DataFrame:
    """packets, of a batch or a stream, with `restarted`: uptime and sequence both go back (modulo 2^32) while the export time doesn't."""
    was = unused(packets, "_was")
    found = _before(packets, exporter, order, ("uptime_ms", "sequence", "export_time"), was)
    back = lambda c: F.pmod(F.col(c) - F.col(f"{was}.{c}"), F.lit(2**32)) >= 2**31
    again = back("uptime_ms") & back("sequence") & (F.col("export_time") >= F.col(f"{was}.export_time"))
    return found.withColumn("restarted", F.coalesce(again, F.lit(False))).drop(was)
