"""The daily job: new feed bodies in, new articles, vectors and a digest out."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.render import Style
from feedloom.functions.rules import item_error
from feedloom.functions.text import is_blank, trim_space
from feedloom.operators import digest, ingest, ranking, seen
from feedloom.operators.enrich import Provider, embed_articles, enrich_items
from feedloom.operators.joins import if_few
from feedloom.schemas import ARTICLE_COLUMNS, ARTICLES, EMBEDDING_DIM
from feedloom.sources.documents import entries

log = logging.getLogger(__name__)

REJECTED = T.StructType([T.StructField(name, T.StringType()) for name in ("stage", "feed_id", "url", "reason")])


def wanted_bodies(raw_feeds: DataFrame, feeds: DataFrame) -> DataFrame:
    """Bodies of the active feeds, with the feed's name and a key of the body.

    Feeds are matched to bodies before these are parsed, salted by the fetch: a
    feed polled far more often than others is spread, and bodies of inactive
    feeds are never parsed.
    """
    named = ingest.with_feed_name(raw_feeds, feeds.where("is_active"), spread_by=("fetched_at", "body"))
    return named.withColumn("body_key", F.xxhash64("body"))


def listed(bodies: DataFrame) -> DataFrame:
    """Where every item stands and why it cannot be stored, if so: no text of it.
    Unreadable bodies are rows as well; entries without a link are no items."""
    rows = entries(bodies, keep_unreadable=True)
    readable = F.col("item_pos").isNotNull()
    rows = rows.where(~readable | ~is_blank(F.col("link")))
    url = trim_space(F.col("link"))
    reason = F.when(~readable, "unreadable").otherwise(item_error(F.coalesce(trim_space(F.col("title")), F.lit("")), url))
    return rows.select("feed_id", "feed_name", "fetched_at", "body_key", "item_pos", url.alias("url"), reason.alias("reason"))


def items_at(bodies: DataFrame, places: DataFrame) -> DataFrame:
    """The whole items at these places. Only bodies that hold one are parsed again."""
    body = ["feed_id", "fetched_at", "body_key"]
    some = bodies.join(if_few(places.select(body).distinct()), body, "left_semi")
    return ingest.at_places(ingest.normalise_items(entries(some)), places)


def staged(rows: DataFrame, path: str) -> DataFrame:
    """The rows, written out, so that nothing before them is computed again."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles written by day. The schema is given, as a run without any leaves no file."""
    return spark.read.schema(T.StructType([*ARTICLES.fields, T.StructField("day", T.DateType())])).parquet(path)


@dataclass(frozen=True)
class Curated:
    """New articles, their vectors and everything that failed, all written."""

    articles: DataFrame
    embeddings: DataFrame
    rejected: DataFrame  # stage, feed_id, url, reason
    items_checked: int
    new_articles: int


def curate(
    raw_feeds: DataFrame,
    feeds: DataFrame,
    unseen: Callable[[DataFrame], DataFrame],
    provider: Provider,
    as_of: Column,
    path: Callable[[str], str],
    dim: int,
) -> Curated:
    """Parse, check, drop known URLs, enrich and embed; ``path`` names where each step is written.
    ``unseen`` gives the places whose URL is not stored; it is given a written table.

    Places and URLs are staged, not texts: most of what is polled is stored already.
    ``answers`` and ``vectors_made`` hold what the provider made, so that no answer is
    asked for twice; like ``listed``, ``first_places`` and ``new_places`` they may go after the run.
    """
    bodies = wanted_bodies(raw_feeds, feeds)
    counted = Observation()
    found = listed(bodies).observe(counted, F.count("item_pos").alias("items"))
    rows = staged(found, path("listed"))
    first = staged(ingest.first_places(rows.where("reason IS NULL").drop("reason")), path("first_places"))
    places = staged(unseen(first), path("new_places"))

    valid, failed = enrich_items(items_at(bodies, places), provider, as_of, lambda f: staged(f, path("answers")))
    made = ingest.write_articles(valid, path("articles"), "overwrite")
    new = read_articles(rows.sparkSession, path("articles"))
    vectors, unembedded = embed_articles(new, provider, as_of, dim, lambda f: staged(f, path("vectors_made")))
    vectors = staged(vectors, path("embeddings"))

    def of(stage: str, frame: DataFrame) -> DataFrame:
        return frame.select(F.lit(stage).alias("stage"), "feed_id", "url", "reason")

    unembedded = unembedded.join(new.select(F.col("id").alias("article_id"), "feed_id", "url"), "article_id")
    lost = rows.where("reason IS NOT NULL")
    rejected = (
        of("parse", lost.where("item_pos IS NULL"))
        .unionByName(of("check", lost.where("item_pos IS NOT NULL")))
        .unionByName(of("enrich", failed))
        .unionByName(of("embed", unembedded))
    )
    return Curated(new, vectors, staged(rejected, path("rejected")), counted.get["items"], made)


@dataclass(frozen=True)
class Run:
    """What a run left behind; all frames read written tables."""

    articles: DataFrame  # only the new ones, by day
    embeddings: DataFrame  # only the new ones
    rejected: DataFrame
    top: DataFrame
    chunks: DataFrame  # digest_date, chunk_no, body; no rows when there is nothing to send
    items_checked: int = 0
    new_articles: int = 0


def run_daily(
    feeds: DataFrame,
    articles: DataFrame,
    raw_feeds: DataFrame,
    provider: Provider,
    as_of: Column,
    out: str,
    top_n: int = ranking.DEFAULT_TOP,
    dim: int = EMBEDDING_DIM,
    style: Style = Style(),
    send: Callable[[DataFrame], None] | None = None,
    filters: DataFrame | None = None,
) -> Run:
    """Write ``articles`` (by day), ``embeddings``, ``rejected``, ``top`` and ``digest_chunks``
    below ``out``, and hand the chunks to ``send`` unless there are none. A
    failure to send is logged and the digest returned all the same.

    The provider's answers are written before anything reads them a second time,
    so a lost executor costs no answer twice after that point.

    With ``filters`` (``operators.seen``) of the stored articles, which then have their ``day`` as a partition
    column, only days that may hold a polled URL are looked at. The filters of the new articles
    are written below ``out`` too, to be added to those of the stored ones.
    """
    spark = feeds.sparkSession
    stored = articles.select(ARTICLE_COLUMNS)
    if feeds.where("is_active").isEmpty():
        # without an active feed there is no ranking and nothing is sent
        nothing = stored.limit(0)
        digests = digest.as_digest(nothing, as_of)
        empty_vectors = nothing.select(
            F.col("id").alias("article_id"), F.array().cast("array<float>").alias("embedding"), "created_at"
        )
        return Run(nothing, empty_vectors, spark.createDataFrame([], REJECTED), nothing, digest.deliverable(digests, style))

    def unseen(places: DataFrame) -> DataFrame:
        return ingest.unseen_staged(places, stored) if filters is None else seen.unseen_by_filters(places, articles, filters)

    found = curate(raw_feeds, feeds, unseen, provider, as_of, lambda name: f"{out}/{name}", dim)
    if filters is not None:
        seen.write_filters(found.articles, f"{out}/filters", mode="overwrite")

    def best(ranked) -> DataFrame:
        """The best of the stored and the new articles, each ranked by itself."""
        both = ranked(articles, as_of, top_n).select(ARTICLE_COLUMNS)
        both = both.unionByName(ranked(found.articles, as_of, top_n).select(ARTICLE_COLUMNS))
        return both.orderBy(*ranking.best_first()).limit(ranking.top_size(top_n))

    top = staged(best(ranking.top_of_day), f"{out}/top")
    if top.isEmpty():  # history is only read on a day without any article
        top = staged(best(ranking.top_or_latest), f"{out}/top_of_all")
    top = top.orderBy(*ranking.best_first())
    digests = digest.as_digest(top, as_of)
    digest.write_digest(digests, f"{out}/digest_chunks", style)
    chunks = spark.read.parquet(f"{out}/digest_chunks")
    if send is not None and not chunks.isEmpty():
        try:
            send(chunks)
        except Exception as failure:
            log.warning("the digest was not sent: %s", failure)
    return Run(found.articles, found.embeddings, found.rejected, top, chunks, found.items_checked, found.new_articles)
