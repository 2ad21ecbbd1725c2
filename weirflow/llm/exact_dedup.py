"""Exact dedup by skew-safe combining: locally, then by salted digest, then across salts.

A group is keyed by its digest and its full text, so texts are compared in full wherever groups are combined:

1. locally: the map side of the aggregation leaves one row of each text in a task, whatever their number;
2. by (digest, salt, text): what the tasks hold of a hot digest is dealt over `salts` by task, and combined there;
3. by (digest, text): the winners of the salts, `salts` at most for each text.

Digests that aren't hot need no salt: their first combination across tasks is the last. A text passes one shuffle,
but for the salt winners of hot digests. Everything is Spark's own aggregation, which spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_hot

SALTS = 16
#: A digest is hot, and its rows are salted, from this share of all rows on. So at most 1 / HOT_SHARE digests are hot.
HOT_SHARE = 0.0005
#: ... but never below this many rows.
HOT_ROWS = 1000


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Column | None, payload: list[str]) -> DataFrame:
    """id, digest, text (null as empty) and row: the payload without a text that `text` has already."""
    text = F.col(f"`{text_col}`")
    plain = F.coalesce(text.cast("string"), F.lit(""))
    kept = [F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(payload) if not _is_text(docs, c, text_col)]
    row = F.struct(text.isNull().alias("blank"), *kept)
    return docs.select(F.col(f"`{id_col}`").alias("id"), (F.sha2(plain, 256) if digest is None else digest).alias("digest"), plain.alias("text"), row.alias("row"))


def _is_text(docs: DataFrame, name: str, text_col: str) -> bool:
    return name == text_col and dict(docs.dtypes)[name] == "string"


def _combined(rows: DataFrame, hot: DataFrame, salts: int, first: list[Column], again: list[Column]) -> DataFrame:
    """One row for each digest and text of rows; `first` aggregates rows, `again` the results of `first`."""
    cold = rows.join(F.broadcast(hot), "digest", "left_anti").groupBy("digest", "text").agg(*first)
    warm = rows.join(F.broadcast(hot), "digest", "left_semi").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    return cold.unionByName(warm.groupBy("digest", "salt", "text").agg(*first).groupBy("digest", "text").agg(*again))


def _winners(rows: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """digest, text, id, n, row of the row with the largest id of each text."""
    best = F.max_by(F.struct("id", "row"), F.struct("id"))
    found = _combined(rows, hot, salts, [F.count("*").alias("n"), best.alias("best")], [F.sum("n").alias("n"), F.max_by("best", F.struct("best.id")).alias("best")])
    return found.select("digest", "text", "best.id", "n", "best.row")


def _decided(rows: DataFrame, names: DataFrame, hot: DataFrame, salts: int) -> DataFrame:
    """id, digest, keep_id, n, text of every row of rows; names are their ids and digests. text is null where the digest tells it.

    Texts are combined in full once. A digest with one text, as all have but by a weak function, ties its rows to that text;
    of the others, rows and groups meet by the text itself.
    """
    first, again = [F.max("id").alias("keep_id"), F.count("*").alias("n")], [F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")]
    groups = cut(_combined(rows.drop("row"), hot, salts, first, again).select("digest", "keep_id", "n"))
    by_digest = groups.groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.min("n").alias("n"))
    single = by_digest.where("texts = 1").drop("texts")
    tied = join_hot(names, single, "digest", hot, "inner").select("id", "digest", "keep_id", "n", F.lit(None).cast("string").alias("text"))
    several = cut(by_digest.where("texts > 1").select("digest"))
    if several.take(1):
        mixed = rows.drop("row").join(several, "digest", "left_semi")
        by_text = _combined(mixed, hot, salts, first, again)
        tied = tied.unionByName(mixed.join(by_text, ["digest", "text"]).select("id", "digest", "keep_id", "n", "text"))
    return tied


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    payload: list[str] | None = None,
    digest: Column | None = None,
    salts: int = SALTS,
    hot_rows: int = HOT_ROWS,
    hot_share: float = HOT_SHARE,
) -> tuple[DataFrame, DataFrame]:
    """(winners, losers): every row of docs is in exactly one of the two.

    Winners have id, digest, group_size and row, a struct of the payload columns (the text, if none are named); losers have id,
    digest, keep_id and group_size. The row with the largest id stays; a null id is the smallest, and of rows with equal id and
    text one stays, which of them is open, as they don't differ in what is compared. A null text is equal to an empty one. An empty
    table gives two empty results. Very long texts are rows like others. Columns of docs may have any names: they stay inside `row`.
    `digest` may be any function of the text; a weak one costs time, not correctness.
    """
    columns = payload or [text_col]
    rows = _rows(docs, id_col, text_col, digest, columns)
    names = cut(rows.select("id", "digest"))
    hot = hot_keys(names, "digest", hot_share, hot_rows)
    own = [F.when(~F.col("row.blank"), F.col("text")).alias(c) if _is_text(docs, c, text_col) else F.col(f"row._{i}").alias(c) for i, c in enumerate(columns)]
    winners = _winners(rows, hot, salts).select("id", "digest", F.col("n").alias("group_size"), F.struct(*own).alias("row"))
    tied = _decided(rows, names, hot, salts)
    late = tied.where(~F.col("id").eqNullSafe(F.col("keep_id")))
    twice = tied.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("id", "digest", "keep_id", "n", "text").count().where("count > 1")
    twice = twice.withColumn("again", F.explode(F.sequence(F.lit(2), F.col("count").cast("int"))))
    return winners, late.unionByName(twice.select(*late.columns)).select("id", "digest", "keep_id", F.col("n").alias("group_size"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; a null id is the smallest; of a text whose largest id comes twice, both rows are kept.
    """
    rows = _rows(docs, "doc_id", "text", None, ["text"])
    names = cut(rows.select("id", "digest"))
    tied = _decided(rows, names, hot_keys(names, "digest", HOT_SHARE, HOT_ROWS), SALTS)
    return tied.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each text, with all their columns, whatever their names.

    Null and empty texts are one text; of rows with equal id and text one stays; a null id is the smallest. An empty table stays empty.
    """
    rows = _rows(docs, "doc_id", "text", None, docs.columns)
    hot = hot_keys(cut(rows.select("digest")), "digest", HOT_SHARE, HOT_ROWS)
    own = [F.when(~F.col("row.blank"), F.col("text")).alias(c) if _is_text(docs, c, "text") else F.col(f"row._{i}").alias(c) for i, c in enumerate(docs.columns)]
    return _winners(rows, hot, SALTS).select(*own)


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
