from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weirflow.llm.exact_dedup import dedup, dedup_report, exact_dedup

ROWS = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "x" * 200_000), (7, "x" * 200_000), (8, "A"), (9, "a"), (9, "a"), (None, "b"), (None, "z")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows), key=repr)


@pytest.mark.parametrize("options", [{}, {"hot_rows": 1, "hot_share": 0.0}, {"weak": True}, {"weak": True, "hot_rows": 1, "salts": 3}])
def test_matches_brute_force(spark, options):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    options = dict(options)
    if options.pop("weak", False):
        options["digest"] = F.lit("same")
    winners, losers = exact_dedup(docs, **options)
    won = [(r.id, r.id, r.group_size) for r in winners.collect()]
    lost = [(r.id, r.keep_id, r.group_size) for r in losers.collect()]
    assert sorted(won + lost, key=repr) == brute(ROWS)
    assert len(won) == len({t or "" for _, t in ROWS})


def test_empty_and_extra_columns(spark):
    assert dedup_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a", 7, "k", 2), (2, "a", 8, "l", 3)], "doc_id long, text string, n int, digest string, rank int")
    assert [tuple(r) for r in dedup(docs).collect()] == [(2, "a", 8, "l", 3)]
    assert dedup(docs).columns == docs.columns


def test_report_over_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted(((r.doc_id, r.keep_id, r.group_size) for r in dedup_report(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
