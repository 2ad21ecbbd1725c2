"""Runs a query and its SQL on the same files and compares rows, whatever their order."""

import math
from pathlib import Path

import duckdb


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.12g}")
    if hasattr(value, "tzinfo") and value.tzinfo:
        return value.replace(tzinfo=None)
    return value


def differences(spark, name, query, sql, sf_dir):
    db = duckdb.connect()
    db.sql("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    theirs = db.sql(sql)
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    if columns != sorted(theirs.columns):
        return f"{name}: columns {columns} against {sorted(theirs.columns)}"
    rows = lambda got, names: sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in got), key=repr)
    a, b = rows([tuple(r) for r in df.collect()], df.columns), rows(theirs.fetchall(), theirs.columns)
    if a == b:
        return ""
    return f"{name}: {len(a)} rows against {len(b)}; {[x for x in zip(a, b) if x[0] != x[1]][:2]}"
