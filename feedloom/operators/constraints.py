"""What a database would enforce on write, as counts of broken rules and as splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import schemas as S
from feedloom.functions import rules
from feedloom.functions.text import is_uuid


def _counts(frame: DataFrame, **broken: Column) -> DataFrame:
    """The rules that one row can break by itself, all in one scan."""
    counted = frame.agg(*[F.count_if(condition).alias(rule) for rule, condition in broken.items()])
    pairs = [F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("broken")) for rule in broken]
    return counted.select(F.inline(F.array(*pairs)))


def _surplus(frame: DataFrame, key: str, rule: str) -> DataFrame:
    """Rows beyond the first of each key; counted from one row per key and task."""
    counts = frame.groupBy(key).agg((F.count("*") - 1).alias("extra"))
    return counts.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("broken")).select(F.lit(rule).alias("rule"), "broken")


def _dangling(frame: DataFrame, key: str, targets: DataFrame, rule: str) -> DataFrame:
    """Rows whose key is no id of the target; one row per key and task moves."""
    counts = frame.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    missing = counts.join(targets.select("id"), "id", "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("broken")).select(F.lit(rule).alias("rule"), "broken")


def rule_report(feeds: DataFrame, articles: DataFrame, embeddings: DataFrame, searches: DataFrame, dim: int) -> DataFrame:
    """One row per rule with the number of rows that break it."""
    col = F.col
    bad_score = ~F.coalesce(col("quality_score").between(S.MIN_SCORE, S.MAX_SCORE), F.lit(False))
    parts = [
        _counts(
            feeds,
            feed_text_length=(F.length("url") > S.MAX_URL) | (F.length("name") > S.MAX_FEED_NAME),
            feed_id_uuid=~is_uuid(col("id")),
        ),
        _counts(
            articles,
            article_text_length=(F.length("url") > S.MAX_URL) | (F.length("title") > S.MAX_TITLE),
            score_range=bad_score,
            article_id_uuid=~is_uuid(col("id")) | ~is_uuid(col("feed_id")),
        ),
        _counts(embeddings, embedding_dimension=F.size("embedding") != dim),
        _counts(searches, search_text=rules.query_error(col("query")).isNotNull()),
        _surplus(feeds, "url", "feed_url_unique"),
        _surplus(articles, "url", "article_url_unique"),
        _surplus(embeddings, "article_id", "embedding_unique"),
        _dangling(articles, "feed_id", feeds, "article_feed_exists"),
        _dangling(embeddings, "article_id", articles, "embedding_article_exists"),
    ]
    return reduce(DataFrame.unionByName, parts)


def split_articles(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid articles, and the others with the first rule they break."""
    checked = articles.withColumn("reason", rules.article_error(F.col("title"), F.col("url"), F.col("quality_score")))
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def split_embeddings(embeddings: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    checked = embeddings.withColumn(
        "reason",
        F.when(~is_uuid(F.col("article_id")), "invalid_id").when(
            F.coalesce(F.size("embedding"), F.lit(-1)) != dim, "wrong_dimension"
        ),
    )
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")
