"""Digests: ranked articles gathered per day, rendered, and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.render import Style, html_chunks, html_text, markdown_text


def gather(ranked: DataFrame) -> DataFrame:
    """(day, rank, article columns) to one row per day with its array of articles.

    The input is a top-n per day, so the arrays hold n articles at most.
    """
    article = F.struct("rank", "id", "title", "url", "quality_score", "summary")
    return ranked.groupBy("day").agg(F.array_sort(F.collect_list(article)).alias("articles"))


def as_digest(top: DataFrame, as_of: Column) -> DataFrame:
    """The one digest of a run, from a top-n result; one row even if that is empty."""
    order = F.struct((-F.col("quality_score")).alias("s"), (-F.unix_micros("created_at")).alias("c"), F.col("id").alias("i"))
    article = F.struct(order.alias("order"), "id", "title", "url", "quality_score", "summary")
    return top.agg(F.array_sort(F.collect_list(article)).alias("articles")).select(as_of.alias("day"), "articles")


def chunks(digests: DataFrame, style: Style = Style()) -> DataFrame:
    """(digest_date, chunk_no, body) of each digest, chunks counted from 0."""
    day = F.col("day").cast("timestamp")
    return digests.select(
        F.to_date("day").alias("digest_date"),
        F.posexplode(html_chunks(day, F.col("articles"), style)).alias("chunk_no", "body"),
    )


def html(digests: DataFrame, style: Style = Style()) -> DataFrame:
    day = F.col("day").cast("timestamp")
    return digests.select(F.to_date("day").alias("digest_date"), html_text(html_chunks(day, F.col("articles"), style)).alias("body"))


def markdown(digests: DataFrame, style: Style = Style()) -> DataFrame:
    day = F.col("day").cast("timestamp")
    return digests.select(F.to_date("day").alias("digest_date"), markdown_text(day, F.col("articles"), style).alias("body"))


def deliverable(digests: DataFrame, style: Style = Style()) -> DataFrame:
    """Chunks to send: none for a digest without articles."""
    return chunks(digests.where(F.size("articles") > 0), style)


def write_digest(digests: DataFrame, path: str, style: Style = Style()) -> None:
    deliverable(digests, style).write.mode("overwrite").parquet(path)
