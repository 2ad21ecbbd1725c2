"""The queries of this subpackage for the driver: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, decontaminate, exact_dedup, fixity, html_text, line_join, manifest, mixing, ngram_join, ns_kmeans, pseudonyms, quality, secrets
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_html_text": lambda spark, d: html_text.report(table(spark, d, "pages")),
        "op2_merkle_fixity": lambda spark, d: fixity.report(table(spark, d, "pages")),
        "op3_line_join": lambda spark, d: line_join.join_report(table(spark, d, "documents")),
        "op4_exact_dedup": lambda spark, d: exact_dedup.dedup_report(table(spark, d, "documents")),
        "op5_pseudonyms": lambda spark, d: pseudonyms.report(table(spark, d, "documents")),
        "op6_ngram_jaccard_join": lambda spark, d: ngram_join.join_report(table(spark, d, "documents")),
        "op7_mixing": lambda spark, d: mixing.report(table(spark, d, "documents")).drop("shards"),
        "op8_secrets": lambda spark, d: secrets.report(table(spark, d, "documents")),
        "op9_quality": lambda spark, d: quality.score_report(table(spark, d, "documents"), table(spark, d, "labels")),
        "op10_decontamination": lambda spark, d: decontaminate.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), unnamed=True),
        "op11_byte_bpe": lambda spark, d: byte_bpe.report(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        "op12_ns_kmeans": lambda spark, d: ns_kmeans.report(table(spark, d, "embeddings")),
        "op13_merkle_manifest": lambda spark, d: manifest.report(table(spark, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_merkle_fixity": fixity.ORACLE,
        "op3_line_join": line_join.ORACLE,
        "op4_exact_dedup": exact_dedup.ORACLE,
        "op6_ngram_jaccard_join": ngram_join.ORACLE,
        "op7_mixing": mixing.ORACLE,
        "op10_decontamination": decontaminate.ORACLE,
        "op12_ns_kmeans": ns_kmeans.ORACLE,
        "op13_merkle_manifest": manifest.ORACLE,
    }
