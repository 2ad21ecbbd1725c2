"""PII: format-preserving Feistel pseudonyms of validated numbers and dates, in DataFrame functions only.

A value is found by its pattern, validated (check digits, ranges, calendar) and permuted within its format by a
keyed Feistel network: the same value gets the same pseudonym in every document, different values get different
ones, and who holds the key can invert it. What is invalid stays as it is.

* card: 13 to 19 digits with a right Luhn digit. The first digit stays, the others are permuted, the Luhn digit is made anew.
* ssn: ddd-dd-dddd; area 001-899 but 666, group and serial not zero. Permuted among the valid ones.
* phone: with + or in the shapes (ddd) ddd-dddd and ddd-ddd-dddd. A country code stays; the last ten digits are permuted.
* ip: four numbers up to 255, permuted among all.
* date: of 1800 to 2199, as yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy or mm/dd/yyyy, permuted among the days of those years.
* iban: with right check digits. Country stays, letters stay letters and digits digits, check digits are made anew.
* email: local part up to 64 characters; its letters and digits are permuted within their kinds, the domain stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w/-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+(])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w-])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
_DAYS = 146_097  # of any 400 years: 189 * 773


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _number(*parts: Column) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, base_a: Column, base_b: Column, key: Column, invert: bool = False) -> Column:
    """(a, b) permuted among all pairs with 0 <= a < base_a and 0 <= b < base_b: rounds add a keyed number to one side."""

    def step(s: Column, i: Column) -> Column:
        sign = -1 if invert else 1
        new_a = F.pmod(s["a"] + sign * (_number(key, i.cast("string"), s["b"].cast("string")) % base_a), base_a)
        new_b = F.pmod(s["b"] + sign * (_number(key, i.cast("string"), s["a"].cast("string")) % base_b), base_b)
        return F.when(i % 2 == 0, F.struct(new_a.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), new_b.alias("b")))

    turns = F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(F.reverse(turns) if invert else turns, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _digits(digits: Column, key: Column, invert: bool) -> Column:
    """A string of up to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    return _let(F.floor(n / 2).cast("int"), lambda h: _let(
        feistel(F.substring(digits, F.lit(1), h), F.substring(digits, h + 1, n), F.pow(F.lit(10), h).cast("long"), F.pow(F.lit(10), n - h).cast("long"), F.concat_ws("|", key, n), invert),
        lambda p: F.concat(F.when(h > 0, F.lpad(p["a"].cast("string"), h, "0")).otherwise(""), F.lpad(p["b"].cast("string"), n - h, "0")),
    ))


def _laid(layout: Column, digits: Column) -> Column:
    """The layout with its digits replaced, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(s: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substring(digits, s["next"], F.lit(1))).otherwise(c)).alias("out"), (s["next"] + digit.cast("int")).alias("next"))

    return F.aggregate(F.split(layout, ""), start, step, lambda s: s["out"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; the last digit is doubled if `doubled` is 0, else the one before it."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: (d.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1)))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0))


def _card(m: Column, key: Column, invert: bool) -> Column:
    def made(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _digits(F.substring(d, F.lit(2), F.length(d) - 2), F.concat(key, F.lit("|card|"), F.substring(d, 1, 1)), invert))
        return F.when(luhn_sum(d, 1) % 10 == 0, _let(body, lambda b: _laid(m, F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string")))))

    return _let(F.regexp_replace(m, "[ -]", ""), made)


def _ssn(m: Column, key: Column, invert: bool) -> Column:
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group >= 1) & (serial >= 1)
    a = (area - 1 - (area > 666).cast("int")) * 99 + group - 1
    permuted = feistel(a, serial - 1, F.lit(898 * 99), F.lit(9999), F.concat(key, F.lit("|ssn")), invert)

    def text(p: Column) -> Column:
        low = F.floor(p["a"] / 99) + 1
        return F.concat_ws("-", F.lpad((low + (low >= 666).cast("int")).cast("string"), 3, "0"), F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(permuted, text))


def _phone(m: Column, key: Column, invert: bool) -> Column:
    def made(d: Column) -> Column:
        cut = F.greatest(F.length(d) - 10, F.when(m.startswith("+"), 1).otherwise(0))
        code = F.substring(d, F.lit(1), cut)
        valid = (F.length(d) >= 8) & (F.length(d) <= 15)
        return F.when(valid, _laid(m, F.concat(code, _digits(F.substring(d, cut + 1, F.length(d)), F.concat(key, F.lit("|phone|"), code), invert))))

    return _let(F.regexp_replace(m, "[^0-9]", ""), made)


def _ip(m: Column, key: Column, invert: bool) -> Column:
    def made(q: Column) -> Column:
        p = feistel(F.get(q, 0) * 256 + F.get(q, 1), F.get(q, 2) * 256 + F.get(q, 3), F.lit(65536), F.lit(65536), F.concat(key, F.lit("|ip")), invert)
        text = lambda x: F.concat_ws(".", F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256)
        # a leading zero would not come back, so such a quad is no address
        return F.when(F.forall(q, lambda x: x <= 255) & ~m.rlike(r"(^|\.)0\d"), _let(p, text))

    return _let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), made)


def _date(m: Column, key: Column, invert: bool) -> Column:
    first = m.rlike("^[0-9]{4}")
    day_first = m.contains(".")
    piece = lambda at: F.substring(F.regexp_replace(m, "[^0-9]", ""), F.lit(at), F.lit(2)).cast("int")
    year = F.when(first, piece(1) * 100 + piece(3)).otherwise(piece(5) * 100 + piece(7))
    month = F.when(first, piece(5)).when(day_first, piece(3)).otherwise(piece(1))
    day = F.when(first, piece(7)).when(day_first, piece(1)).otherwise(piece(3))

    def made(x: Column) -> Column:
        y, mo, d = x["y"], x["m"], x["d"]
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        last = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, 28 + leap.cast("int")).otherwise(31)
        valid = (y >= 1800) & (y <= 2199) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= last)
        start = F.lit("1800-01-01").cast("date")
        at = F.datediff(F.make_date(y, mo, d), start)
        permuted = feistel(F.floor(at / 773), at % 773, F.lit(189), F.lit(773), F.concat(key, F.lit("|date")), invert)
        text = lambda v: F.when(first, F.concat(F.date_format(v, "yyyyMMdd"))).when(day_first, F.date_format(v, "ddMMyyyy")).otherwise(F.date_format(v, "MMddyyyy"))
        return F.when(valid, _let(permuted, lambda p: _laid(m, text(F.date_add(start, (p["a"] * 773 + p["b"]).cast("int"))))))

    return _let(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), made)


def _string(s: Column, key: Column, invert: bool) -> Column:
    """A string of up to 64 characters: two halves take turns to shift each other's letters and digits within their kinds."""
    kinds = [(F.lit("0123456789"), 10), (F.lit("abcdefghijklmnopqrstuvwxyz"), 26), (F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), 26)]
    sign = -1 if invert else 1

    def shifted(half: Column, by: Column) -> Column:
        def moved(c: Column, i: Column) -> Column:
            n = F.conv(F.substring(by, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
            out = c
            for letters, size in kinds:
                at = F.instr(letters, c)
                out = F.when(at > 0, F.substring(letters, F.pmod(at - 1 + sign * n, F.lit(size)) + 1, F.lit(1))).otherwise(out)
            return out

        return F.when(F.length(half) > 0, F.array_join(F.transform(F.split(half, ""), moved), "")).otherwise(half)

    def step(x: Column, i: Column) -> Column:
        by = lambda other: F.sha2(F.concat_ws("|", key, i.cast("string"), other), 512)
        return F.when(i % 2 == 0, F.struct(shifted(x["a"], by(x["b"])).alias("a"), x["b"].alias("b"))).otherwise(F.struct(x["a"].alias("a"), shifted(x["b"], by(x["a"])).alias("b")))

    turns = F.sequence(F.lit(1), F.lit(ROUNDS))
    h = F.floor(F.length(s) / 2).cast("int")
    halves = F.struct(F.substring(s, F.lit(1), h).alias("a"), F.substring(s, h + 1, F.length(s)).alias("b"))
    return F.aggregate(F.reverse(turns) if invert else turns, halves, step, lambda x: F.concat(x["a"], x["b"]))


def _email(m: Column, key: Column, invert: bool) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(_string(local, F.concat(key, F.lit("|email|"), F.lower(domain)), invert), F.lit("@"), domain)


def _mod97(s: Column) -> Column:
    """Of letters (A = 10 and on) and digits read as one number."""
    def step(r: Column, c: Column) -> Column:
        at = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(at > 9, (r * 100 + at) % 97).otherwise((r * 10 + at) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), step)


def _iban(m: Column, key: Column, invert: bool) -> Column:
    def made(s: Column) -> Column:
        country, rest = F.substring(s, 1, 2), F.substring(s, F.lit(5), F.length(s))
        valid = (_mod97(F.concat(rest, F.substring(s, 1, 4))) == 1) & F.length(s).between(15, 34)
        new = _let(_string(rest, F.concat(key, F.lit("|iban|"), country), invert), lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        spaced = lambda x: F.when(m.contains(" "), F.trim(F.regexp_replace(x, "(.{4})", "$1 "))).otherwise(x)
        return F.when(valid & (m == spaced(s)), spaced(new))

    return _let(F.regexp_replace(m, " ", ""), made)


_MAKE = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _named(kind: str, m: Column) -> Callable[[Column], Column]:
    return lambda text: F.struct(F.when(text.isNotNull(), kind).alias("kind"), F.coalesce(text, m).alias("text"))


def pseudonym(m: Column, key: Column, invert: bool = False) -> Column:
    """struct<kind, text> of one match; kind is null and text m itself if no kind finds m valid."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))
    for kind in reversed(KINDS):
        # the match begins where its kind's pattern does, so the kind is the first whose whole pattern it is
        made = _let(_MAKE[kind](m, key, invert), _named(kind, m))
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), made).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "pii_kinds", invert: bool = False) -> DataFrame:
    """docs with pseudonyms in the text, and a column with the kinds of the values replaced, in order of place.

    Null texts stay null, empty ones empty. Long texts and repeated rows are handled like others. Other columns stay; one
    named like found_col is replaced. With invert and the same key, pseudonyms become the values again.
    """
    text = F.col(text_col).cast("string")
    matches = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, F.lit(key), invert))
    held = unused(docs, "_made")
    found = docs.withColumn(held, F.when(F.regexp_like(text, F.lit(ANY)), matches))
    pieces = F.zip_with(F.split(text, ANY, -1), held, lambda gap, x: F.concat(gap, F.coalesce(x["text"], F.lit(""))))
    found = found.withColumn(text_col, F.when(F.col(held).isNotNull(), F.array_join(pieces, "")).otherwise(text))
    kinds = F.transform(F.filter(held, lambda x: x["kind"].isNotNull()), lambda x: x["kind"])
    return found.withColumn(found_col, F.when(F.col(held).isNotNull(), kinds).otherwise(F.expr("array()").cast("array<string>"))).drop(held)


def report(docs: DataFrame, key: str = "weirflow") -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, and n_<kind> of each kind."""
    found = pseudonymise(docs.select("doc_id", "text"), key)
    counts = [(F.size("pii_kinds") - F.size(F.array_remove("pii_kinds", kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", "text", *counts)
