"""Corpus pipeline: the stages that turn raw documents into a training mix.

Each stage takes what its predecessor kept and returns the columns of documents; the last adds where each document
goes in the mix. Stages read the whole text of every document they get.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import decontaminate, exact_dedup, mixing, ngram_join, quality
from weirflow.llm.common import stored, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels beside the documents.

    Null and empty texts go by the score of the bias alone; repeated rows share their fate; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays.

    Null and empty texts are one text; a null id is the smallest; of rows with equal id and text one stays.
    """
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the least id stays.

    Of rows with that id, the one with the least hash of its text; texts without words all stay; null ids come last.
    """
    return ngram_join.thin(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, whatever the item's id, null too.

    Null, empty and blank texts hold nothing and stay; repeated rows share their fate.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), unnamed=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time a document is in the mix, with its shard and position there.

    A null source is a source, the last; texts without words have no size; an empty table gives an empty mix.
    """
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("exact_dedup", exact),
    ("ngram_join", near),
    ("decontamination", clean),
    ("mixing", mixed),
]

#: Most stages can't be said in SQL; the tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
