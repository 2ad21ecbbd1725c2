import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm.mixing import allot, mix, report, source_targets, split


def brute_targets(sizes):
    """By resharing the excess until nothing is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        rest, weights = total - sum(capped.values()), sum(weight[s] for s in free)
        target = capped | {s: rest * weight[s] / weights for s in free}
        above = [s for s in free if target[s] > 3 * sizes[s]]
        if not above:
            return target
        capped |= {s: 3.0 * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 2, "c": 3000, None: 5}, {"a": 0, "b": 9}, {f"s{i}": (i * 37) % 101 + (i == 7) * 9000 for i in range(40)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(rows).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_split_is_exact():
    quotas = np.array([100, 0, 7, 900])
    counts = split(quotas, 6)
    assert (counts.sum(axis=0) == quotas).all() and np.ptp(counts.sum(axis=1)) <= 1


def check(rows, docs):
    """rows: the report of docs."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, most, taken, targets = {}, {}, {}, {}
    for d in docs:
        sizes[d.source] = sizes.get(d.source, 0) + count(d.text)
        most[d.source] = max(most.get(d.source, 0), count(d.text))
    want = brute_targets(sizes)
    source = {d.doc_id: d.source for d in docs}
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6


def test_report_over_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = report(docs).collect()
    check(rows, docs.collect())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, report(docs.repartition(7)).collect()))


def test_mix_matches_report(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix(docs, shards=5).withColumn("n", F.size(F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"))).toPandas()
    taken = rows.groupby("doc_id").n.sum()
    assert all(taken.get(r.doc_id, 0) == r.taken for r in report(docs).collect())
    for _, shard in rows.groupby("mix_shard"):
        assert sorted(shard.mix_position) == list(range(len(shard)))
    assert not rows.duplicated(["doc_id", "mix_pass"]).any()
    _, draws = allot(docs, shards=5)
    assert np.ptp([r["count"] for r in draws.groupBy("shard").count().collect()]) <= 1


def test_hard_rows(spark):
    rows = [(1, "a b c", None, 1), (2, None, "x", 2), (3, "", "y", 3), (4, "w " * 50_000, "z", 4), (5, "a b", "z", 5), (6, "one", "é", 6), (7, "q r s\x0bt", "Z", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rank int")
    check(report(docs).collect(), docs.collect())
    assert mix(docs).columns == [*docs.columns, "mix_shard", "mix_pass", "mix_position"]
    assert report(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
    twice = docs.union(docs.where("doc_id = 5"))
    assert report(twice).count() == 8 and {r["count"] for r in report(twice).where("doc_id = 5").groupBy("taken").count().collect()} == {2}
