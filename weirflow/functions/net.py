"""Addresses and networks. Keys are 4 or 16 bytes, so containment is a range of binaries that parquet can prune by."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LOCAL_NETWORKS


def _parsed(value: str | None) -> tuple[str | None, bytes | None]:
    try:
        address = ipaddress.ip_address(value) if value else None
    except ValueError:
        address = None
    return (str(address), address.packed) if address else (None, None)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("key", T.BinaryType())]))
def address(values: pd.Series) -> pd.DataFrame:
    """Canonical text and key of an address; both null if it isn't one. Each distinct value of a batch is parsed once."""
    codes, distinct = pd.factorize(values)
    parsed = [_parsed(x) for x in distinct] + [(None, None)]
    return pd.DataFrame([parsed[c] for c in codes], columns=["text", "key"])


def is_ipv6(text: Column) -> Column:
    """Whether a text is an IPv6 address without a zone: eight groups, or fewer with one `::`; a dotted quad stands for the last two."""
    quad = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
    plain = F.regexp_replace(text, "(?<=:)" + quad, "0:0")
    group = "[0-9A-Fa-f]{1,4}"
    short = plain.rlike(f"^(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?$")
    groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
    return F.coalesce(plain.rlike(f"^{group}(?::{group}){{7}}$") | short & (groups <= 7), F.lit(False))


def unmapped(parsed: Column) -> Column:
    """An `address` with IPv4 addresses that are mapped into IPv6 as what they are: four bytes and dotted text."""
    key = parsed["key"]
    mapped = (F.octet_length(key) == 16) & (F.substring(F.hex(key), 1, 24) == "00000000000000000000FFFF")
    last = F.substring(key, F.lit(13), F.lit(4))
    text = F.concat_ws(".", *[F.conv(F.hex(F.substring(last, F.lit(i), F.lit(1))), 16, 10) for i in range(1, 5)])
    return F.when(mapped, F.struct(text.alias("text"), last.alias("key"))).otherwise(parsed)


def version(key: Column) -> Column:
    """4 for four bytes and for addresses mapped into IPv6, else 6."""
    mapped = (F.octet_length(key) == 16) & (F.substring(F.hex(key), 1, 24) == "00000000000000000000FFFF")
    return F.when((F.octet_length(key) == 4) | mapped, 4).when(F.octet_length(key) == 16, 6).cast("smallint")


def bounds(cidr: str, as_number: bool = False) -> tuple:
    """(first, last) key of a network; host bits are cleared."""
    net = ipaddress.ip_network(cidr.strip(), strict=False)
    first, last = net.network_address, net.broadcast_address
    return (int(first), int(last)) if as_number else (bytearray(first.packed), bytearray(last.packed))


def in_network(key: Column, cidr: str, as_number: bool = False) -> Column:
    """Containment. A range of binaries alone could let a key of the other length in, so the length is asked too."""
    low, high = bounds(cidr, as_number)
    inside = (key >= F.lit(low)) & (key <= F.lit(high))
    return inside if as_number else inside & (F.octet_length(key) == len(low))


def is_local(key: Column, networks: tuple[str, ...] = LOCAL_NETWORKS, as_number: bool = False) -> Column:
    found = F.lit(False)
    for cidr in networks:
        found = found | in_network(key, cidr, as_number)
    return found


def direction(src: Column, dst: Column, networks: tuple[str, ...] = LOCAL_NETWORKS, as_number: bool = False) -> Column:
    here, there = is_local(src, networks, as_number), is_local(dst, networks, as_number)
    known = F.when(here & there, "internal").when(here, "outbound").when(there, "inbound").otherwise("external")
    return F.when(src.isNull() | dst.isNull(), "unknown").otherwise(known)
