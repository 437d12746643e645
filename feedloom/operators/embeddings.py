"""Changes to the table of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.vectors import mrl_reduce
from feedloom.operators.constraints import split_embeddings
from feedloom.operators.enrich import Provider, embed_articles
from feedloom.operators.joins import if_few
from feedloom.schemas import EMBEDDINGS


def upsert_embeddings(base: DataFrame, updates: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Replace or add vectors by article, and the updates that cannot be stored.

    The latest update of an article wins, of equally late ones the larger vector,
    so that a task run again picks the same.

    Updates shrink to one row per article before the join, so an article that is
    updated over and over is a hot key nowhere. While the updated articles are
    few, the stored vectors are not shuffled. ``updates`` is read more than once:
    write what a provider made before passing it.
    """
    columns = EMBEDDINGS.fieldNames()
    good, rejected = split_embeddings(updates.select(columns), dim)
    latest = (
        good.groupBy("article_id")
        .agg(F.max(F.struct("created_at", "embedding")).alias("row"))
        .select("article_id", "row.embedding", "row.created_at")
    )
    replaced = if_few(good.select("article_id").distinct())
    return base.select(columns).join(replaced, "article_id", "left_anti").unionByName(latest), rejected


def redimension(articles: DataFrame, provider: Provider, dim: int, model: str, as_of: Column) -> DataFrame:
    """A new version of the table: every article embedded again, tagged with the model."""
    vectors, _ = embed_articles(articles, provider, as_of, dim)
    return vectors.select("article_id", "embedding", F.lit(model).alias("model"), "created_at")


def reduce_stored(embeddings: DataFrame, dim: int, model: str) -> DataFrame:
    """Shorter vectors from the stored ones, where the model's leading values suffice."""
    return embeddings.select("article_id", mrl_reduce(F.col("embedding"), dim).alias("embedding"), F.lit(model).alias("model"), "created_at")
