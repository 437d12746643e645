"""The curation tables, derived from the given parquet files.

``documents`` plays the incoming items, those of them with a row in ``labels``
are what an earlier run has stored, ``source`` is the feed, and ``embeddings``
holds the vectors of the articles with the same number. Ids made from numbers are
UUID-shaped and sort like the numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.text import escape_html, format_summary, trim_space, uuid_from
from feedloom.operators.enrich import OfflineProvider
from feedloom.operators.ingest import split_storable
from feedloom.schemas import ARTICLE_COLUMNS

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered_id(number: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


def after(seconds: Column) -> Column:
    return F.timestamp_seconds(F.lit(EPOCH) + seconds)


def feed_url(source: Column) -> Column:
    return F.concat(F.lit("https://"), source, F.lit("/rss"))


def feeds(spark: SparkSession, folder: str) -> DataFrame:
    url = feed_url(F.col("source"))
    since = after(F.col("first") * 3600)
    return (
        read(spark, folder, "documents")
        .groupBy("source")
        .agg(F.min("doc_id").alias("first"))
        .select(
            uuid_from(url).alias("id"),
            url.alias("url"),
            F.col("source").alias("name"),
            (~F.col("source").like("%3")).alias("is_active"),
            since.alias("created_at"),
            since.alias("updated_at"),
        )
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Titles are the first lines; some are longer than a title may be."""
    return read(spark, folder, "documents").select(
        uuid_from(feed_url(F.col("source"))).alias("feed_id"),
        F.col("source").alias("feed_name"),
        F.col("doc_id").alias("item_pos"),
        trim_space(F.substring_index("text", "\n", 1)).alias("title"),
        F.concat(F.lit("https://ex/"), F.md5(F.col("text").cast("binary"))).alias("url"),
        F.col("text").alias("content"),
        after(F.col("doc_id") * 60).alias("published_at"),
        "n_chars",
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """What is stored: the storable items with a label, one per URL.

    One aggregate per column instead of one over a struct: those a query does not
    ask for are pruned and their texts stay out of the shuffle.
    """
    labels = read(spark, folder, "labels").select(F.col("doc_id").alias("item_pos"), "quality")
    storable, _ = split_storable(items(spark, folder))
    labelled = OfflineProvider().summarise(storable.join(labels, "item_pos"))
    rows = labelled.select(
        "item_pos",
        numbered_id(F.col("item_pos")).alias("id"),
        "feed_id",
        "title",
        "url",
        F.col("content").alias("raw_content"),
        format_summary(F.col("three_line_summary"), F.col("key_takeaways")).alias("summary"),
        (1 + 4 * F.col("quality") + F.col("n_chars") % 6).cast("int").alias("quality_score"),
        "published_at",
        after(F.col("item_pos") * 3600).alias("created_at"),
    )
    first = [F.min_by(c, "item_pos").alias(c) for c in ARTICLE_COLUMNS if c != "url"]
    return rows.groupBy("url").agg(*first).select(ARTICLE_COLUMNS)


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "embeddings").select(
        numbered_id(F.col("vec_id")).alias("article_id"),
        "embedding",
        after(F.col("vec_id") * 3600).alias("created_at"),
        "vec_id",
        "label",
    )


def raw_feeds(documents: DataFrame) -> DataFrame:
    """One feed body per document, the language deciding the dialect.

    en: RSS 2.0 with full content, and an entry without a link; fr: RSS with a
    description only and a Dublin Core date, every other one as RSS 1.0; de: Atom with
    two links, no published date and a second entry, every other one with title
    and content as XHTML; any other: JSON Feed. A body whose text holds a table bar
    is cut off before its end and cannot be read.
    """
    d = documents
    title = escape_html(trim_space(F.substring_index("text", "\n", 1)))
    text = escape_html(F.col("text"))
    url = F.concat(F.lit("https://ex/"), F.md5(F.col("text").cast("binary")))
    when = after(F.col("doc_id") * 60)
    iso = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rss = F.concat(
        F.lit('<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>'),
        F.col("source"),
        F.lit("</title><item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><description>short</description>"),
        F.lit("<content:encoded>"), text, F.lit("</content:encoded><pubDate>"),
        F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"),
        F.lit("<item><title>no link</title><link> </link></item></channel></rss>"),
    )
    dublin = F.concat(
        F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>'),
        F.col("source"),
        F.lit("</title><item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><description>"), text,
        F.lit("</description><dc:date>"), iso, F.lit("</dc:date></item></channel></rss>"),
    )
    rdf = F.concat(
        F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" '
              'xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>'),
        F.col("source"),
        F.lit("</title></channel><item><title>"), title, F.lit("</title><link>"), url, F.lit("</link><description>"), text,
        F.lit("</description><dc:date>"), iso, F.lit("</dc:date></item></rdf:RDF>"),
    )
    odd = F.col("doc_id") % 2 == 1
    division = F.lit('<div xmlns="http://www.w3.org/1999/xhtml"><p>')
    atom = F.concat(
        F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title type="text">'),
        F.col("source"),
        F.lit("</title><entry>"),
        F.when(odd, F.concat(F.lit('<title type="xhtml">'), division, title, F.lit("</p></div></title>")))
        .otherwise(F.concat(F.lit('<title type="html">'), title, F.lit("</title>"))),
        F.lit('<link rel="self" href="https://self/"/><link href="'), url, F.lit('"/><updated>'), iso, F.lit("</updated>"),
        F.when(odd, F.concat(F.lit('<content type="xhtml">'), division, text, F.lit("</p></div></content>")))
        .otherwise(F.concat(F.lit('<content type="html">'), text, F.lit("</content>"))),
        F.lit('</entry><entry><title>More</title><link href="'), url, F.lit('/more"/><updated>'), iso,
        F.lit("</updated><summary>more</summary></entry></feed>"),
    )
    json = F.to_json(
        F.struct(
            F.lit("https://jsonfeed.org/version/1.1").alias("version"),
            F.col("source").alias("title"),
            F.array(
                F.struct(
                    trim_space(F.substring_index("text", "\n", 1)).alias("title"),
                    url.alias("url"),
                    F.col("text").alias("content_html"),
                    iso.alias("date_published"),
                )
            ).alias("items"),
        )
    )
    lang = F.col("lang")
    body = F.when(lang == "en", rss).when((lang == "fr") & odd, rdf).when(lang == "fr", dublin).when(lang == "de", atom).otherwise(json)
    cut = F.substring("body", F.lit(1), F.length("body") - 9)
    return d.withColumn("body", body).select(
        uuid_from(feed_url(F.col("source"))).alias("feed_id"),
        after(F.col("doc_id") * 60).alias("fetched_at"),
        F.when(F.col("text").contains("|"), cut).otherwise(F.col("body")).alias("body"),
    )
