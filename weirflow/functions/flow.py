"""Scalar functions of the flow model."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import PROTOCOLS, TRANSPORTS

# Keywords that mark a key as sensitive, and what stands in for its value.
SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "authorization", "auth", "cookie", "session", "credential")
MASK = "***MASKED***"


def first_error(*checks: tuple[Column, str]) -> Column:
    """The name of the first check whose condition holds, else null."""
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in checks])


def protocol_name(number: Column) -> Column:
    found = F.lit("unknown")
    for n, name in PROTOCOLS.items():
        found = F.when(number == n, name).otherwise(found)
    return found


def protocol_number(name: Column) -> Column:
    found = F.lit(0)
    for n, known in PROTOCOLS.items():
        found = F.when(name == known, n).otherwise(found)
    return found.cast("smallint")


def transport(name: Column) -> Column:
    """The transport by its name, case and outer blanks aside; null if it is none."""
    plain = F.lower(F.trim(name))
    return F.when(plain.isin(*TRANSPORTS), plain)


#: A time with its offset; the offset and the seconds are required.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def unused(df: DataFrame, name: str) -> str:
    """A name for a column of passage that df hasn't."""
    while name in df.columns:
        name += "_"
    return name


def time_of(text: Column) -> Column:
    """The timestamp of an RFC 3339 text, to microseconds; null for any other text."""
    return F.when(text.rlike(RFC3339), F.try_to_timestamp(text))


def nanos_of(text: Column) -> Column:
    """What an RFC 3339 text has beyond microseconds, in nanoseconds."""
    return F.rpad(F.regexp_extract(text, r"\.\d{6}(\d{1,3})", 1), 3, "0").cast("int")


def rfc3339(ts: Column, nanos: Column | None = None) -> Column:
    """UTC text with as many digits of the second as needed, none for whole seconds; nanos are beyond microseconds."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = text if nanos is None else F.concat(text, F.lpad(F.coalesce(nanos, F.lit(0)).cast("string"), 3, "0"))
    return F.concat(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit("Z"))


def joined(*parts: Column, by: str = "|") -> Column:
    """Texts of the parts, null as empty."""
    return F.concat_ws(by, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def idempotency_key(native: Column, start_nanos: Column | None = None, end_nanos: Column | None = None) -> Column:
    """Of a flow's columns and its native identity; equal flows of one source have equal keys."""
    c = F.col
    parts = (c("schema_version"), c("source_type"), c("collector_id"), c("source_host"), native, rfc3339(c("event_start_time"), start_nanos), rfc3339(c("event_end_time"), end_nanos),
             c("src_ip"), c("dst_ip"), c("src_port"), c("dst_port"), c("protocol_number"), c("bytes"), c("packets"))
    return F.concat(F.lit("sha256:"), F.sha2(joined(*parts), 256))


def tuple_identity() -> Column:
    c = F.col
    return F.concat(F.lit("tuple:"), F.sha2(joined(rfc3339(c("event_start_time")), c("src_ip"), c("dst_ip"), c("protocol_number")), 256))


def uuid7(at: Column, seed: Column) -> Column:
    """A version 7 UUID of a time and of whatever makes the row its own: the same row gets the same id again."""
    rest = F.sha2(seed.cast("string"), 256)
    stamp = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(rest, 4, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(stamp, 1, 8), F.lit("-"), F.substring(stamp, 9, 4), F.lit("-7"), F.substring(rest, 1, 3), F.lit("-"), variant, F.substring(rest, 5, 3), F.lit("-"), F.substring(rest, 8, 12))


def is_uuid7(value: Column) -> Column:
    return F.coalesce(F.lower(value).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))


def sensitive(key: Column) -> Column:
    """Whether a key, with - . and blanks as _, is a keyword or holds one after or before a _."""
    plain = F.lower(F.translate(key, "-. ", "___"))
    words = "|".join(SENSITIVE)
    return plain.rlike(f"^({words})$|_({words})|({words})_")


#: Finds a keyword anywhere: a text without it has no sensitive key.
SENSITIVE_WORD = "(?i)" + "|".join(w.replace("_", "[-_. ]") for w in SENSITIVE)


def _is_sensitive(key: str) -> bool:
    plain = key.lower().translate(str.maketrans("-. ", "___"))
    return any(plain == w or f"_{w}" in plain or f"{w}_" in plain for w in SENSITIVE)


def _masked(value):
    if isinstance(value, dict):
        return {k: MASK if _is_sensitive(k) else _masked(v) for k, v in value.items()}
    return [_masked(x) for x in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def mask_json(texts: pd.Series) -> pd.Series:
    """JSON objects with the values of sensitive keys masked at any depth, keys in order; what isn't an object becomes {}.

    Each distinct text of a batch is masked once.
    """

    def one(text: str | None) -> str:
        try:
            value = json.loads(text) if text else {}
        except ValueError:
            value = {}
        return json.dumps(_masked(value if isinstance(value, dict) else {}), sort_keys=True, separators=(",", ":"))

    codes, distinct = pd.factorize(texts)
    masked = [one(x) for x in distinct] + [one(None)]
    return pd.Series([masked[c] for c in codes], dtype=object)


def labels_key(labels: Column) -> Column:
    """JSON of a map with its keys in order; {} for none."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels)))), F.lit("{}"))


def labels_text(labels: Column) -> Column:
    """k="v" pairs in order of key, with backslash, quote and line feed escaped."""
    safe = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), safe(e["value"]), F.lit('"'))), ",")
