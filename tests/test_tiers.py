"""Tiers kept up by partial sums: equal to what all flows give, whatever came late, twice or to an end in the middle."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow.operators import tiers
from weirflow.operators.flows import tier

T = datetime(2026, 6, 16)
SCHEMA = "event_start_time timestamp, src_ip_key binary, dst_ip_key binary, src_port int, dst_port int, transport_protocol string, protocol_number int, source_type string, collector_id string, direction string, bytes long, packets long"


def flows(spark, seed, days, n=60):
    rng = random.Random(seed)
    rows = [(T + timedelta(days=rng.choice(days), seconds=rng.randrange(86400)), bytearray([rng.randrange(3)]), bytearray([1]), rng.choice([1, None]), 80, "tcp", 6, "rest_json", "c", "outbound", rng.choice([None, 5, 7]), 1) for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows(df):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()), key=repr)


def check(spark, path, *batches):
    every = batches[0]
    for b in batches[1:]:
        every = every.unionByName(b)
    for kind, keys in tiers.TIERS.items():
        for width in tiers.WIDTHS:
            want = tier(every, width, keys)
            assert rows(tiers.current(spark, path, kind, width).select(*want.columns)) == rows(want), (kind, width)


def test_notes_and_folds(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tiers.current(spark, path, "ports", "5m") is None and tiers.fold(spark, path) == []
    a, b, c = flows(spark, 1, [0, 1, 2]), flows(spark, 2, [1]), flows(spark, 3, [1, 3])
    tiers.note(a, path, 0)
    check(spark, path, a)
    assert tiers.fold(spark, path) == ["2026-06-16", "2026-06-17", "2026-06-18"]
    check(spark, path, a)
    tiers.note(b, path, 1)
    tiers.note(b, path, 1)  # a batch that runs again
    tiers.note(a, path, 0)  # and one that is folded
    check(spark, path, a, b)
    tiers.note(c, path, "by hand")
    assert tiers.fold(spark, path) == ["2026-06-17", "2026-06-19"]
    check(spark, path, a, b, c)
    state = tiers._state(tiers._Folder(spark, path))
    assert state["days"] == {"2026-06-16": 1, "2026-06-17": 2, "2026-06-18": 1, "2026-06-19": 2}  # others weren't written anew
    assert (state["upto"], state["others"]) == (1, ["by hand"])
    day = tiers.current(spark, path, "ports", "1h", [T.date()])
    assert rows(day) == rows(tier(a.where(F.to_date("event_start_time") == F.lit(T.date())), "1h", tiers.TIERS["ports"]).select(*day.columns))
    assert tiers.due(spark, path, T) == {f"{k}_{w}": 0 for k in tiers.TIERS for w in tiers.WIDTHS}


def test_a_fold_that_ends_in_the_middle(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    a, b = flows(spark, 4, [0]), flows(spark, 5, [0, 1])
    tiers.note(a, path, 0)
    tiers.fold(spark, path)
    tiers.note(b, path, 1)
    replace, delete = tiers._Folder.replace, tiers._Folder.delete

    def fails(self, name, *text):
        raise OSError("lost")

    monkeypatch.setattr(tiers._Folder, "replace", fails)  # days are written, but never named
    with pytest.raises(OSError, match="lost"):
        tiers.fold(spark, path, "one")
    monkeypatch.setattr(tiers._Folder, "replace", replace)
    check(spark, path, a, b)
    monkeypatch.setattr(tiers._Folder, "delete", lambda self, name: fails(self, name) if name != "_lease" else delete(self, name))  # named, but nothing is deleted
    with pytest.raises(OSError, match="lost"):
        tiers.fold(spark, path, "two")
    monkeypatch.setattr(tiers._Folder, "delete", delete)
    check(spark, path, a, b)
    tiers.note(b, path, 1)
    assert tiers.fold(spark, path) == []
    check(spark, path, a, b)


def test_lease(spark, tmp_path):
    path = str(tmp_path / "t")
    tiers.note(flows(spark, 6, [0]), path, 0)
    folder = tiers._Folder(spark, path)
    tiers._lease(folder, "other", 1000.0)
    with pytest.raises(tiers.Held):
        tiers.fold(spark, path, "me", now=1000.0 + tiers.LEASE_S - 1)
    assert tiers.fold(spark, path, "me", now=1000.0 + tiers.LEASE_S + 1) == ["2026-06-16"]
    assert not folder.exists("_lease")
