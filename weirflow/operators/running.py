"""What a row takes from those before it in its key, where a key may have a third of all rows.

A window over a key's whole history is one task. Here a history is cut into spans of time: windows stay within (key, span), an
aggregation leaves one row for each of them, and only those rows meet in a window over the key. What comes before a span is
joined to it, by (key, span). So the work of one task is a key's rows of a span, and a row for each span of its history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a span; a column of numbers counts as seconds.
SPAN_S = 3600


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df hasn't."""
    out = []
    for name in names:
        while name in df.columns:
            name += "_"
        out.append(name)
    return out


def span(df: DataFrame, at: str, seconds: int = SPAN_S) -> Column:
    """The number of the span that a time or number lies in; null for null."""
    kind = dict(df.dtypes)[at]
    if kind == "timestamp_ntz":
        number = F.unix_seconds(F.to_utc_timestamp(F.col(at).cast("timestamp"), F.current_timezone()))
    elif kind in ("timestamp", "date"):
        number = F.unix_seconds(F.col(at).cast("timestamp"))
    else:
        number = F.col(at)
    return F.floor(number / seconds).cast("bigint")


def _joined(rows: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what ends has for their keys, nulls being equal."""
    named = ends.withColumnsRenamed({k: f"{k}__" for k in keys})
    both = rows.join(named, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys], "left")
    return both.drop(*[f"{k}__" for k in keys])


def previous(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], columns: tuple[str, ...], to: str = "previous", seconds: int = SPAN_S) -> DataFrame:
    """df with a struct of the columns of the row before, by order, among those of its keys; null for the first.

    order begins with the time that spans are cut by; nulls come first. Rows that are equal in order come in any order. Null keys
    are a key. A column called `to` is replaced.
    """
    part, own, end, number = unused(df, "part", "own", "end", "number")
    cut = [*keys, part]
    value = F.struct(*columns)
    w = Window.partitionBy(*cut).orderBy(*order)
    rows = df.withColumn(part, span(df, order[0], seconds))
    ends = rows.groupBy(*cut).agg(F.max_by(value, F.struct(*order)).alias(end))
    over = Window.partitionBy(*keys).orderBy(part)
    before = ends.select(*cut, F.lag(end).over(over).alias(end))
    rows = rows.withColumn(own, F.lag(value).over(w)).withColumn(number, F.row_number().over(w))
    return _joined(rows, before, cut).withColumn(to, F.when(F.col(number) == 1, F.col(end)).otherwise(F.col(own))).drop(part, own, end, number)


def running_sum(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: Column, to: str = "total", seconds: int = SPAN_S) -> DataFrame:
    """df with the sum of a value over the rows of its keys up to this one; as `previous` about order, nulls and equal rows."""
    part, own, end, amount = unused(df, "part", "own", "end", "amount")
    cut = [*keys, part]
    w = Window.partitionBy(*cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn(part, span(df, order[0], seconds)).withColumn(amount, value)
    over = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*cut).agg(F.sum(amount).alias(end)).select(*cut, F.sum(end).over(over).alias(end))
    rows = rows.withColumn(own, F.sum(amount).over(w))
    return _joined(rows, before, cut).withColumn(to, F.coalesce(end, F.lit(0)) + F.coalesce(own, F.lit(0))).drop(part, own, end, amount)
