"""From parsed entries to new articles: cleaning, first-per-URL, existence checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from feedloom.functions import rules
from feedloom.functions.text import is_blank, strip_html, trim_space, uuid_from
from feedloom.operators.joins import attach, drop_matching, few, keep_matching
from feedloom.schemas import ARTICLE_COLUMNS


def normalise_items(entries: DataFrame) -> DataFrame:
    """Entries (title, link, content, description, published, updated, ...) to items."""
    body = F.when(is_blank(F.col("content")), F.col("description")).otherwise(F.col("content"))
    return (
        entries.where(~is_blank(F.col("link")))
        .withColumn("title", F.coalesce(trim_space(F.col("title")), F.lit("")))
        .withColumn("url", trim_space(F.col("link")))
        .withColumn("content", F.coalesce(strip_html(body), F.lit("")))
        .withColumn("published_at", F.coalesce("published", "updated"))
        .drop("link", "description", "published", "updated")
    )


def split_storable(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items that can be stored, and the others with their reason.

    This comes before ``first_per_url``: a URL counts as seen only once an item
    with it could be stored.
    """
    checked = items.withColumn("reason", rules.item_error(F.col("title"), F.col("url")))
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


PLACE = ("feed_name", "feed_id", "fetched_at", "body_key", "item_pos")


def _place(items: DataFrame) -> list[str]:
    """The columns that say where an item stood; they tell items apart."""
    return [c for c in PLACE if c in items.columns]


def first_places(items: DataFrame) -> DataFrame:
    """URL and place of the first item of each URL, feeds taken by name and items by
    position, and ``copies`` of that very place.

    No text travels, and the aggregations begin before the shuffle: however many
    copies a URL has, one row per map task leaves for it.
    """
    place = _place(items)
    counted = items.groupBy("url", *place).agg(F.count("*").alias("copies"))
    first = counted.groupBy("url").agg(F.min(F.struct(*place, "copies")).alias("first"))
    return first.select("url", *[F.col(f"first.{c}").alias(c) for c in [*place, "copies"]])


def at_places(items: DataFrame, places: DataFrame) -> DataFrame:
    """The whole items at these places, one for each. While the places are few, the
    items stay where they are."""
    keys = ["url", *_place(items)]
    wanted = places.select(*[F.col(c).alias(f"_{c}") for c in keys], "copies")
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])

    def of(part: DataFrame) -> DataFrame:
        return items.join(part, same, "left_semi").select(items.columns)

    # items that stand at one place several times are copies of one item
    return of(wanted.where("copies = 1")).unionByName(of(wanted.where("copies > 1")).dropDuplicates(["url"]))


def first_per_url(items: DataFrame) -> DataFrame:
    """The first item of each URL, found by place; texts are joined to the winners."""
    return at_places(items, first_places(items))


def unseen(items: DataFrame, articles: DataFrame) -> DataFrame:
    """Items (or places) whose URL is not stored."""
    return items.join(articles.select("url"), "url", "left_anti").select(items.columns)


def unseen_staged(items: DataFrame, articles: DataFrame) -> DataFrame:
    """``unseen`` for items that were written to a table and may be read twice.

    A usual run brings few items for a long history. Their URLs then go to the
    scan of the stored URLs, and only those that occur come back: the history is
    read, one column of it, but not shuffled. A backfill takes the other way.
    """
    urls = items.select("url")
    if not few(urls):
        return unseen(items, articles)
    known = articles.select("url").join(F.broadcast(urls), "url", "left_semi").distinct()
    return items.join(F.broadcast(known), "url", "left_anti").select(items.columns)


def _identity(rows: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in ("url", "fetched_at", "item_pos") if c in rows.columns)


def of_known_feeds(items: DataFrame, feeds: DataFrame) -> DataFrame:
    ids = feeds.select(F.col("id").alias("feed_id"))
    return keep_matching(items, ids, "feed_id", spread_by=_identity(items)).select(items.columns)


def of_unknown_feeds(items: DataFrame, feeds: DataFrame) -> DataFrame:
    ids = feeds.select(F.col("id").alias("feed_id"))
    return drop_matching(items, ids, "feed_id", spread_by=_identity(items)).select(items.columns)


def new_items(items: DataFrame, articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Storable, first of their URL, of a known feed and not stored yet."""
    storable, _ = split_storable(items)
    known = of_known_feeds(storable, feeds)
    return at_places(known, unseen(first_places(known), articles))


def to_articles(items: DataFrame, as_of: Column) -> DataFrame:
    """Enriched items as rows of the articles table, ids derived from the URL."""
    return items.select(
        uuid_from(trim_space(F.col("url"))).alias("id"),
        "feed_id",
        trim_space(F.col("title")).alias("title"),
        trim_space(F.col("url")).alias("url"),
        F.col("content").alias("raw_content"),
        trim_space(F.col("summary")).alias("summary"),
        "quality_score",
        "published_at",
        as_of.alias("created_at"),
    )


def insert_articles(articles: DataFrame, created: DataFrame) -> DataFrame:
    return articles.select(ARTICLE_COLUMNS).unionByName(created.select(ARTICLE_COLUMNS))


def write_articles(created: DataFrame, path: str, mode: str = "append", folders: bool = True) -> int:
    """Write to a table partitioned by day, which rankings and fetches prune by, and give the number of rows.
    Without ``folders`` the day is a column of files in order of the day, whose statistics tell which files hold a day: for a history
    of very many days with few articles each, where a folder and a file a day would be most of the work.
    Rows are cut by day and id into ranges of about equal size, so a day with very
    many articles is written by several tasks and a small one into one file. They are
    counted behind the cut, on their way into the files: the cut reads them a first time."""
    days = created.select(ARTICLE_COLUMNS).withColumn("day", F.to_date("created_at"))
    cut = days.repartitionByRange("day", "id").sortWithinPartitions("day", "created_at")
    written = Observation()
    rows = cut.observe(written, F.count("*").alias("rows")).write.mode(mode)
    (rows.partitionBy("day") if folders else rows).parquet(path)
    return written.get["rows"]


def url_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("url").agg(F.count("*").alias("n"))


def run_counters(items: DataFrame, fresh: DataFrame) -> DataFrame:
    """Items checked and articles found new, per feed. Both sides shrink to one
    row per feed and map task before anything moves."""
    checked = items.groupBy("feed_id").agg(F.count("*").alias("items_checked"))
    new = fresh.groupBy("feed_id").agg(F.count("*").alias("new_articles"))
    return checked.join(new, "feed_id", "left").select(
        "feed_id", "items_checked", F.coalesce("new_articles", F.lit(0)).alias("new_articles")
    )


def with_feed_name(rows: DataFrame, feeds: DataFrame, spread_by: tuple[str, ...]) -> DataFrame:
    """Only rows of the given feeds, with the feed's name beside them."""
    names = feeds.select(F.col("id").alias("feed_id"), F.col("name").alias("feed_name"))
    return attach(rows, names, "feed_id", spread_by=spread_by)
