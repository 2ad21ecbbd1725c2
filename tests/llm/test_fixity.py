import hashlib

import duckdb
import pytest

from weirflow.llm import fixity

KEYS = ["archive", "offset", "length", "record_id", "verdict"]


def records(spark, rows):
    return spark.createDataFrame(rows, "archive string, offset long, length long, record_id string, content binary, digest string")


BASE = [(a, i * 100, 100, f"{a}{i}", bytes([i % 251]) * 100, "clash") for a in "ab" for i in range(200)]


@pytest.mark.parametrize("fanout", [4, 16])
def test_locates_damage(spark, fanout):
    bad = dict(enumerate(BASE))
    bad[7] = (*BASE[7][:4], b"x" * 100, "c")
    bad[199] = (*BASE[199][:4], b"", "c")
    del bad[50]
    bad[333] = ("b", BASE[333][1] + 1, *BASE[333][2:])
    bad[900] = ("b", 10**5, 5, "new", b"abcde", "c")
    primary, replica = records(spark, BASE), records(spark, list(bad.values()))
    got = fixity.audit(primary, replica, range_bytes=500, fanout=fanout)
    assert sorted((r.offset, r.record_id, r.verdict) for r in got.collect()) == sorted(
        [(700, "a7", "corrupt"), (19900, "a199", "corrupt"), (5000, "a50", "missing"), (13300, "b133", "missing"), (13301, "b133", "extra"), (10**5, "new", "extra")]
    )
    assert all(r.primary_root != r.replica_root for r in got.collect())
    assert fixity.audit(primary, primary, range_bytes=500, fanout=fanout).count() == 0


def test_lost_archives_repeats_and_empty_tables(spark):
    primary = records(spark, BASE + [BASE[0]])
    got = fixity.audit(primary, records(spark, BASE[:200]))
    assert got.where("verdict = 'missing' and archive = 'b' and replica_root is null").count() == 200
    assert [(r.record_id, r.verdict) for r in got.where("archive = 'a'").collect()] == [("a0", "corrupt")]
    assert fixity.audit(primary.limit(0), primary.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None, None, 5), (None, "u", "é" * 70_000, 5), (1, None, None, 5)], "page_id long, url string, html string, length int")
    assert fixity.audit(fixity.pack(pages), fixity.pack(pages)).count() == 0
    packed = fixity.pack(pages).orderBy("archive", "offset").collect()
    assert [r.offset for r in packed][:1] == [0] and all(len(r.content) == r.length for r in packed)
    assert fixity.report(pages.limit(0)).count() == 0


def test_root_by_hand(spark):
    rows = [("a", 0, 1, "r", b"x", ""), ("a", 1, 1, "s", b"y", "")]
    sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()
    low = sha(f"0:1:r:{sha(b'x')}\n1:1:s:{sha(b'y')}")
    tables = fixity.tree(fixity.leaves(records(spark, rows)), 1)
    assert tables[0].first().digest == low and tables[1].first().digest == sha(f"0:{low}")


def test_report_matches_sql(spark):
    db = duckdb.connect()
    db.sql("create view pages as select * from '/root/testdata/sf0.1/pages.parquet'")
    got = fixity.report(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    want = sorted(db.sql(fixity.ORACLE).fetchall())
    assert sorted(tuple(r) for r in got.select(*KEYS).collect()) == want and len(want) > 10
