"""The queries of this package, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import bpe, clustering, exact_dedup, html_extract, language, lexical, licenses, mixing, near_join, quality
from feedloom.llm import sharding, toxicity, url_filter
from feedloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.report(table(spark, folder, "pages"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.report(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.report(table(spark, folder, "pages"), table(spark, folder, "labels"))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(table(spark, folder, "documents"))


def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.report(table(spark, folder, "documents"))


def op7_near_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_join.report(table(spark, folder, "documents"))


def op8_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.report(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.report(table(spark, folder, "documents"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(table(spark, folder, "documents"))


def op11_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.report(table(spark, folder, "documents"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.report(table(spark, folder, "embeddings"))


def registered() -> dict[str, Query]:
    found = (
        op1_html_extract,
        op2_exact_dedup,
        op3_toxicity,
        op4_url_filter,
        op5_mixing,
        op6_license_scan,
        op7_near_join,
        op8_byte_bpe,
        op9_language,
        op10_quality_rules,
        op11_sharding,
        op12_lexical_search,
        op13_clustering,
    )
    return {f.__name__: f for f in found}
