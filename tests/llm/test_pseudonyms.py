import datetime
import re
from datetime import date, timedelta
from hashlib import sha256
from random import Random

from weirflow.llm.pseudonyms import KINDS, pseudonymise, report


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", s))):
        d = int(c) * (1 + i % 2)
        t += d - 9 * (d > 9)
    return t % 10 == 0


GOOD = {
    "email": ["bosbt.42@mail8.example.com", "A.b-C+9@x.org"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "ip": ["42.144.35.254", "0.0.0.0"],
    "date": ["2024-02-29", "1999/12/31", "29.02.2000", "12/31/2023"],
    "ssn": ["123-45-6789", "665-01-0001", "899-99-9999"],
    "phone": ["+1 (988) 555-2485", "(415) 555-0123", "415-555-0123", "+4930123456"],
    "card": ["4041894974608795", "4111 1111 1111 1111", "3782-822463-10005"],
}
BAD = ["4041894974608796", "666-12-1234", "900-12-1234", "123-00-1234", "2023-02-29", "31.04.2020", "256.1.1.1", "1.2.3", "DE88370400440532013000", "12345", "13/31/2023", "a@b"]


def run(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pseudonymise(docs, "k", **options).collect()}
    return [rows[i] for i in range(len(texts))]


def test_formats_and_round_trip(spark):
    values = [v for vs in GOOD.values() for v in vs]
    rows = run(spark, values)
    made = [r.text for r in rows]
    assert [r.pii_kinds for r in rows] == [[k] for k, vs in GOOD.items() for _ in vs]
    for old, new in zip(values, made, strict=True):
        assert old != new
        if old not in GOOD["ip"]:
            assert re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", old))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new)))
    new = dict(zip(values, made, strict=True))
    assert all(luhn(new[v]) and new[v][0] == v[0] for v in GOOD["card"])
    assert all(all(int(x) < 256 for x in new[v].split(".")) for v in GOOD["ip"])
    datetime.date.fromisoformat(new["2024-02-29"])
    datetime.datetime.strptime(new["29.02.2000"], "%d.%m.%Y")
    assert [r.text for r in run(spark, made, invert=True)] == values


def test_values_stay_linked_and_apart(spark):
    rows = run(spark, [f"x 4041894974608795 y é {i}" for i in range(3)] + ["4041-8949-7460-8795 and 2024-01-02, 2024-01-03."])
    assert len({r.text[2:18] for r in rows[:3]}) == 1
    assert rows[3].text[:19].replace("-", "") == rows[0].text[2:18]  # another layout of one number
    assert rows[3].pii_kinds == ["card", "date", "date"]
    days = [r.text for r in run(spark, [str(datetime.date(2020, 1, 1) + datetime.timedelta(i)) for i in range(500)])]
    assert len(set(days)) == 500


def test_invalid_values_stay(spark):
    text = " ; ".join(BAD)
    assert run(spark, [text])[0].text == text and run(spark, [text])[0].pii_kinds == []


def test_hard_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", "b", 2), (3, "w " * 60_000 + "10.0.0.1", "c", 3), (3, "10.0.0.1", "c", 3)], "doc_id long, text string, pii_kinds string, n_ip int")
    rows = sorted(report(docs).collect(), key=lambda r: (r.doc_id, len(r.text or "")))
    assert rows[0].text is None and rows[1].text == "" and rows[3].text.endswith(rows[2].text) and rows[3].n_ip == 1
    assert report(docs.limit(0)).count() == 0
    assert pseudonymise(docs, "k").columns == ["doc_id", "text", "n_ip", "pii_kinds"] or set(pseudonymise(docs, "k").columns) == set(docs.columns)


def test_table_against_patterns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    old = {r.doc_id: r.text for r in docs.collect()}
    counts = dict.fromkeys(KINDS, 0)
    for r in report(docs).collect():
        for kind in KINDS:
            counts[kind] += r[f"n_{kind}"]
        for pattern in (r"(?<!\d)\d{16}(?!\d)", r"[a-z]+\.\d\d@mail", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\d+\.\d+\.\d+\.\d+"):
            before, after = re.findall(pattern, old[r.doc_id] or ""), re.findall(pattern, r.text or "")
            assert len(before) == len(after)
            assert not {x for x in before if len(x) != 16 or luhn(x)} & set(after)
        if not any(r[f"n_{k}"] for k in KINDS):
            assert r.text == old[r.doc_id]
    assert counts["card"] > 5 and counts["phone"] > 5 and counts["email"] > 5 and counts["ip"] > 5


def feistel(a, b, base_a, base_b, key):
    for i in range(1, 9):
        number = int(sha256(f"{key}|{i}|{b if i % 2 == 0 else a}".encode()).hexdigest()[:15], 16)
        a, b = ((a + number) % base_a, b) if i % 2 == 0 else (a, (b + number) % base_b)
    return a, b


def permuted(kind, value, key):
    """The pseudonym of a valid ip, ssn, date (yyyy-mm-dd) or card without blanks, in plain Python."""
    if kind == "ip":
        w, x, y, z = map(int, value.split("."))
        a, b = feistel(w * 256 + x, y * 256 + z, 65536, 65536, f"{key}|ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "ssn":
        areas = [n for n in range(1, 900) if n != 666]
        area, group, serial = map(int, value.split("-"))
        a, b = feistel(areas.index(area) * 99 + group - 1, serial - 1, len(areas) * 99, 9999, f"{key}|ssn")
        return f"{areas[a // 99]:03}-{a % 99 + 1:02}-{b + 1:04}"
    if kind == "date":
        first = date(1800, 1, 1)
        a, b = feistel(*divmod((date.fromisoformat(value) - first).days, 773), 189, 773, f"{key}|date")
        return (first + timedelta(a * 773 + b)).isoformat()
    inner = value[1:-1]
    n, h = len(inner), len(inner) // 2
    a, b = feistel(int(inner[:h]), int(inner[h:]), 10**h, 10 ** (n - h), f"{key}|card|{value[0]}|{n}")
    body = f"{value[0]}{a:0{h}}{b:0{n - h}}"
    return next(body + d for d in "0123456789" if luhn(body + d))


def test_matches_a_plain_network(spark):
    rng = Random(3)
    made = {
        "ip": [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(60)],
        "ssn": [f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 666)]):03}-{rng.randrange(1, 100):02}-{rng.randrange(1, 10000):04}" for _ in range(60)],
        "date": [(date(1800, 1, 1) + timedelta(rng.randrange(146097))).isoformat() for _ in range(58)] + ["1800-01-01", "2199-12-31"],
        "card": [next(x + d for d in "0123456789" if luhn(x + d)) for x in ("".join(str(rng.randrange(10)) for _ in range(rng.randrange(12, 19))) for _ in range(60))],
    }
    pairs = [(kind, value) for kind, values in made.items() for value in values]
    rows = spark.createDataFrame([(i, f"so {value} is it") for i, (_, value) in enumerate(pairs)], "doc_id long, text string")
    found = {r.doc_id: r for r in pseudonymise(rows, "a key").collect()}
    for i, (kind, value) in enumerate(pairs):
        assert (found[i].text, found[i].pii_kinds) == (f"so {permuted(kind, value, 'a key')} is it", [kind])
