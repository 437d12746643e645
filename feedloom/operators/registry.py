"""The feed registry: scans, lookups, and changes as new table states.

Parquet tables know neither DELETE nor MERGE, so every change returns the next
state of the table. Write it to a new path, never over the one being read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import rules
from feedloom.functions.text import canonical_uuid, is_blank, trim_space, uuid_from
from feedloom.operators.joins import attach, drop_matching, few, if_few, keep_matching
from feedloom.schemas import FEED_COLUMNS
from feedloom.session import staged


@dataclass(frozen=True)
class Change:
    """The next table state, and the requests that could not be served."""

    table: DataFrame
    rejected: DataFrame


def active_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.where("is_active").orderBy("name", "id")


def newest_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.orderBy(F.desc("created_at"), "id")


def find_by_id(table: DataFrame, key: str) -> DataFrame:
    """At most one row. A malformed id is simply not found."""
    return table.where(F.col("id") == canonical_uuid(F.lit(key))).limit(1)


def find_feed_by_url(feeds: DataFrame, url: str) -> DataFrame:
    return feeds.where(F.col("url") == url).limit(1)


def lookup_by_id(table: DataFrame, wanted: DataFrame, id_column: str = "id") -> DataFrame:
    """Batch form of ``find_by_id``: one row per wanted id that exists."""
    keys = wanted.select(canonical_uuid(F.col(id_column)).alias("id")).where("id IS NOT NULL").distinct()
    return table.join(if_few(keys), "id", "left_semi")


def lookup_by_url(feeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted url once, with its feed or nulls."""
    return wanted.select("url").distinct().join(feeds, "url", "left")


def add_feeds(feeds: DataFrame, requests: DataFrame, as_of: Column) -> Change:
    """Serve (request_no, url, name, discovered) in request order.

    The first storable request for a URL creates the feed, later ones conflict
    with it, and earlier ones keep the reason they failed for. The winner per URL
    is found with a partial aggregation on (url, request_no) alone and brought
    back salted, so one URL asked for over and over does not load one task.
    """
    checked = (
        requests.withColumn("url", trim_space(F.col("url")))
        .withColumn("name", rules.feed_name(F.col("name"), F.col("discovered"), F.col("url")))
        .withColumn("fault", F.when(is_blank(F.col("url")), "invalid_url").otherwise(rules.feed_error(F.col("url"), F.col("name"))))
        .select("request_no", "url", "name", "fault")
    )
    first = checked.groupBy("url").agg(F.min(F.when(F.col("fault").isNull(), F.col("request_no"))).alias("winner"))
    standing = first.join(feeds.select("url", F.lit(True).alias("stored")), "url", "left")
    judged = attach(checked, standing, "url", spread_by=("request_no",), how="left").withColumn(
        "reason",
        F.when(is_blank(F.col("url")), "invalid_url")
        .when(F.col("stored") | (F.col("request_no") > F.col("winner")), "conflict")
        .otherwise(F.col("fault")),
    )
    created = judged.where("reason IS NULL").select(
        uuid_from(F.col("url")).alias("id"),
        "url",
        "name",
        F.lit(True).alias("is_active"),
        as_of.alias("created_at"),
        as_of.alias("updated_at"),
    )
    return Change(
        feeds.select(FEED_COLUMNS).unionByName(created),
        judged.where("reason IS NOT NULL").select("request_no", "url", "reason"),
    )


def _not_found(feeds: DataFrame, ids: DataFrame) -> DataFrame:
    missing = ids.join(feeds.select("id"), "id", "left_anti")
    return missing.select("id", F.lit("not_found").alias("reason"))


def _apply_status(feeds: DataFrame, changes: DataFrame, status: Column, as_of: Column) -> DataFrame:
    joined = feeds.select(FEED_COLUMNS).join(changes, "id", "left")
    touched = F.col("touched").isNotNull()
    return joined.select(
        "id",
        "url",
        "name",
        F.when(touched, status).otherwise(F.col("is_active")).alias("is_active"),
        "created_at",
        F.when(touched, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def _by_uuid(requests: DataFrame) -> DataFrame:
    """Ids in canonical form; an id that is no UUID stays as it is and finds nothing."""
    return requests.withColumn("id", F.coalesce(canonical_uuid(F.col("id")), F.col("id")))


def requested_ids(requests: DataFrame) -> DataFrame:
    """Every requested (id) once."""
    return _by_uuid(requests).select("id").distinct()


def set_status(feeds: DataFrame, requests: DataFrame, as_of: Column) -> Change:
    """Serve (request_no, id, is_active); the last request for a feed wins."""
    last = _by_uuid(requests).groupBy("id").agg(
        F.max_by(F.col("is_active"), F.col("request_no")).alias("wanted"), F.lit(True).alias("touched")
    )
    return Change(_apply_status(feeds, last, F.col("wanted"), as_of), _not_found(feeds, last))


def flip_status(feeds: DataFrame, requests: DataFrame, as_of: Column) -> Change:
    """Serve flips of (id); two flips of one feed cancel out."""
    flips = _by_uuid(requests).groupBy("id").agg(F.count("*").alias("touched"))
    flipped = F.col("is_active") != (F.col("touched") % 2 == 1)
    return Change(_apply_status(feeds, flips, flipped, as_of), _not_found(feeds, flips))


@dataclass(frozen=True)
class Deletion:
    feeds: DataFrame
    articles: DataFrame
    embeddings: DataFrame
    rejected: DataFrame


def delete_feeds(feeds: DataFrame, articles: DataFrame, embeddings: DataFrame, requests: DataFrame) -> Deletion:
    """Delete feeds by (id), with their articles and those articles' vectors.

    Only ids travel, and they are found once and staged: the vectors to drop are
    found from the dropped articles' ids. Tables are left where they are when the ids are few, and a feed that
    owns a large share of the articles is spread when they are not.
    """
    ids = requested_ids(requests)
    asked = staged(ids.join(feeds.select("id", F.lit(True).alias("found")), "id", "left"), "deleted-feeds")
    gone = asked.where("found").select(F.col("id").alias("feed_id"))
    small = few(gone)
    lost = keep_matching(articles.select("id", "feed_id"), gone, "feed_id", spread_by=("id",), small=small)
    lost = staged(lost.select(F.col("id").alias("article_id")), "deleted-articles")
    return Deletion(
        feeds.join(gone, feeds["id"] == gone["feed_id"], "left_anti"),
        drop_matching(articles, gone, "feed_id", spread_by=("id",), small=small).select(articles.columns),
        embeddings.join(if_few(lost), "article_id", "left_anti").select(embeddings.columns),
        asked.where("found IS NULL").select("id", F.lit("not_found").alias("reason")),
    )
