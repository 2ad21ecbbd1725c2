"""Zeek conn.log lines in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.flow import MASK, SENSITIVE_WORD, first_error, mask_json, sensitive, unused

# Fields of a connection, by kind, and the aliases of dotted names.
TEXTS = ("uid", "id.orig_h", "id.resp_h", "proto", "service", "conn_state", "history")
PORTS = ("id.orig_p", "id.resp_p")
COUNTS = ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "missed_bytes")
FLOATS = ("ts", "duration")
FLAGS = ("local_orig", "local_resp")
ALIASES = {"id_orig_h": "id.orig_h", "id_orig_p": "id.orig_p", "id_resp_h": "id.resp_h", "id_resp_p": "id.resp_p"}


def _name(field: str) -> str:
    return field.replace(".", "_")


MOST_LINE = 1 << 20


def explode(requests: DataFrame, column: str = "value") -> DataFrame:
    """One row per record of requests {"records": [...]}: record_index, `line` and `request_error`.

    A record is an object, or a string that holds a line. Requests without records give one row with an error, as do nulls and blank strings.
    """
    body = F.from_json(column, "records array<string>")["records"]
    listed = requests.select("*", F.posexplode_outer(body).alias("record_index", "line"))
    line = F.trim("line")
    bad = F.coalesce((line == "") | (line == "null"), F.lit(True))
    return listed.withColumns({"record_index": F.coalesce("record_index", F.lit(0)), "line": F.when(~bad, line), "request_error": F.when(bad, "invalid_zeek_conn")})


def bounded(lines: DataFrame, column: str = "value", most: int = MOST_LINE) -> DataFrame:
    """lines of a file or socket stream with `line_error`: longer ones than `most` bytes are set aside, and blank ones left out."""
    kept = lines.where(F.trim(column) != "")
    return kept.withColumn("line_error", F.when(F.octet_length(column) > most, "line_too_long"))


def _of(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with a struct `zeek` of typed fields (dots as _), `extra` (JSON as it came, sensitive keys masked at any depth) and `error`.

    Types are JSON's: numbers must be numbers and not text, counts and ports whole and not negative, flags true or false; a text field of
    another type is null. "-" is null for texts, counts and ports. An alias counts as its dotted name, and both at once must agree.
    """
    held, known, own, kinds, typed_, more, masked = (unused(lines, name) for name in ("_raw", "_known", "_value", "_kind", "_typed", "_extra", "_masked"))
    fields = (*TEXTS, *PORTS, *COUNTS, *FLOATS, *FLAGS)
    typed = ", ".join(f"`{f}` variant" for f in (*fields, *ALIASES))
    steps = {f: n for n, f in enumerate(fields)}  # each step is columns of its own, so that what several rules ask is computed once
    raw = lines.withColumns({held: F.from_json(column, "map<string,variant>"), known: F.from_json(column, typed)})
    get = lambda field: F.col(known).getField(field)
    conflict = F.lit(False)
    aliased = {}
    for alias, field in ALIASES.items():
        both = get(alias).isNotNull() & get(field).isNotNull()
        conflict = conflict | F.coalesce(both & (F.when(both, F.to_json(get(alias))) != F.when(both, F.to_json(get(field)))), F.lit(False))
        aliased[field] = F.coalesce(get(field), get(alias))
    value = lambda f: F.col(f"{own}{steps[f]}")
    kind = lambda f: F.col(f"{kinds}{steps[f]}")
    out = {f: F.col(f"{typed_}{steps[f]}") for f in fields}
    raw = raw.withColumns({f"{own}{n}": aliased.get(f, get(f)) for f, n in steps.items()})
    raw = raw.withColumns({f"{kinds}{n}": F.schema_of_variant(value(f)) for f, n in steps.items()})
    broken, found = F.lit(False), {}
    for f in (*PORTS, *COUNTS):
        number = F.when(kind(f) == "BIGINT", _of(value(f), "bigint"))
        number = F.when(number.between(0, 2**32 - 1 if f in PORTS else 2**63 - 1), number)
        found[f] = number if f in PORTS else number.cast("decimal(20,0)")
        dash = (kind(f) == "STRING") & (_of(value(f), "string") == "-")
        broken = broken | (value(f).isNotNull() & (kind(f) != "VOID") & ~dash & out[f].isNull())
    for f in FLOATS:
        found[f] = F.when(kind(f).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), _of(value(f), "double"))
        broken = broken | (value(f).isNotNull() & out[f].isNull())
    for f in TEXTS:
        found[f] = F.nullif(F.when(kind(f) == "STRING", _of(value(f), "string")), F.lit("-"))
    for f in FLAGS:
        found[f] = F.when(kind(f) == "BOOLEAN", _of(value(f), "boolean"))
    names = F.array(*[F.lit(x) for x in (*fields, *ALIASES)])
    others = F.map_filter(held, lambda k, _: ~F.array_contains(names, k))
    raw = raw.withColumns({f"{typed_}{n}": found[f] for f, n in steps.items()} | {more: F.to_json(F.transform_values(others, lambda k, v: F.when(sensitive(k), F.lit(MASK).cast("variant")).otherwise(v)))})
    nested = F.col(more).rlike(SENSITIVE_WORD) & (F.col(more).contains(":{") | F.col(more).contains("[{"))
    raw = raw.withColumn(masked, mask_json(F.when(nested, F.col(more))))  # Python only sees what may need it, and goes if `extra` isn't asked for
    extra = F.when(nested, F.col(masked)).otherwise(F.col(more))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    error = first_error(
        (F.col(held).isNull(), "invalid_json"),
        (conflict, "conflicting_alias"),
        (broken, "invalid_number"),
        (F.coalesce(out["ts"] <= 0, F.lit(True)) | blank(out["id.orig_h"]) | blank(out["id.resp_h"]) | blank(out["proto"]), "missing_field"),
    )
    record = F.struct(*[out[f].alias(_name(f)) for f in fields], extra.alias("extra"), error.alias("error"))
    return raw.select(*[F.col(f"`{c}`") for c in lines.columns if c != "zeek"], record.alias("zeek"))
