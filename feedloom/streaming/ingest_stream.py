"""New feed bodies in, only unseen articles and their vectors out, safe to run again.

Each micro-batch overwrites paths of its own, so a batch that is tried again
after a failure replaces what it wrote. For that the existence check must not see
the batch's own earlier attempt: it looks at the base articles and at *earlier*
batches only. There is no watermark: the URL alone decides, for good.

A URL counts as seen only once it is stored, and not when it is first polled: an item whose
enrichment failed is tried again when it comes again. So what is remembered from batch to batch
is what was stored: a filter of each batch's URLs (``operators.seen``), merged every
``SEALED`` batches. A batch reads the last merged filter, those since, and the URLs of the few earlier
batches that they name; it neither lists nor reads the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from feedloom import session
from feedloom.operators import ingest, seen
from feedloom.operators.enrich import Provider
from feedloom.plans.daily_run import REJECTED, curate
from feedloom.schemas import ARTICLES, EMBEDDING_DIM, EMBEDDINGS

#: Batches whose filters are merged into one file.
SEALED = 16

_TABLES = {
    "articles": T.StructType([*ARTICLES.fields, T.StructField("day", T.DateType())]),
    "embeddings": EMBEDDINGS,
    "rejected": REJECTED,
}


def written(spark: SparkSession, out: str, table: str = "articles") -> DataFrame:
    """All batches of ``articles``, ``embeddings`` or ``rejected`` so far; the batch id
    is a partition column."""
    schema = T.StructType([*_TABLES[table].fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(schema).option("basePath", f"{out}/{table}").parquet(f"{out}/{table}")


def _read(spark: SparkSession, out: str, table: str, schema: T.StructType, batches: list[int]) -> DataFrame:
    """Some batches of a table, by their paths: the folder of all batches is not listed."""
    whole = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    paths = [f"{out}/{table}/batch_id={n}" for n in batches]
    return spark.read.schema(whole).option("basePath", f"{out}/{table}").parquet(*paths)


_FILTER = T.StructType([T.StructField("words", T.IntegerType()), T.StructField("word", T.IntegerType()), T.StructField("bits", T.LongType())])


def earlier_filters(spark: SparkSession, out: str, batch_id: int) -> DataFrame:
    """Filters of the batches before this one: the last merged one, and those since."""
    merged = batch_id - batch_id % SEALED
    whole = T.StructType([*_FILTER.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(whole).parquet(f"{out}/sealed/{merged}") if merged else None
    since = list(range(merged, batch_id))
    if since:
        recent = _read(spark, out, "filters", _FILTER, since)
        rows = recent if rows is None else rows.unionByName(recent)
    return rows


def _unseen_since(places: DataFrame, out: str, batch_id: int) -> DataFrame:
    """Places whose URL no earlier batch stored."""
    spark = places.sparkSession
    urls = places.select("url")
    named = seen.named_parts(urls, earlier_filters(spark, out, batch_id), "batch_id")
    if not named:
        return places
    earlier = _read(spark, out, "articles", _TABLES["articles"], named)
    return ingest.unseen_staged(places, earlier)


def _seal(spark: SparkSession, out: str, batch_id: int) -> None:
    """Merges the filters of all batches before this one, which begins a new series."""
    first = batch_id - SEALED
    rows = _read(spark, out, "filters", _FILTER, list(range(first, batch_id)))
    if first:
        whole = T.StructType([*_FILTER.fields, T.StructField("batch_id", T.LongType())])
        rows = spark.read.schema(whole).parquet(f"{out}/sealed/{first}").unionByName(rows)
    cut = rows.repartitionByRange("batch_id", "words", "word").sortWithinPartitions("batch_id", "words", "word")
    cut.write.mode("overwrite").parquet(f"{out}/sealed/{batch_id}")


def store_batch(
    feeds: DataFrame,
    base: DataFrame,
    provider: Provider,
    as_of: Column,
    out: str,
    dim: int = EMBEDDING_DIM,
    base_filters: DataFrame | None = None,
) -> Callable[[DataFrame, int], None]:
    """The foreachBatch function: parse, check, drop known URLs, enrich, embed, overwrite."""

    def store(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % SEALED == 0:
            _seal(batch.sparkSession, out, batch_id)

        def unseen(places: DataFrame) -> DataFrame:
            if base_filters is None:
                left = ingest.unseen_staged(places, base)
            else:
                left = seen.unseen_by_filters(places, base, base_filters)
            if batch_id == 0:
                return left
            return _unseen_since(session.staged(left, "unseen"), out, batch_id)

        found = curate(batch, feeds, unseen, provider, as_of, lambda name: f"{out}/{name}/batch_id={batch_id}", dim)
        own = found.articles.select("url", F.lit(batch_id).alias("batch_id"))
        seen.filters_of(own, "batch_id").drop("batch_id").write.mode("overwrite").parquet(f"{out}/filters/batch_id={batch_id}")

    return store


def ingest_available(
    raw_feeds: DataFrame,
    feeds: DataFrame,
    base: DataFrame,
    provider: Provider,
    as_of: Column,
    out: str,
    checkpoint: str,
    dim: int = EMBEDDING_DIM,
    base_filters: DataFrame | None = None,
) -> StreamingQuery:
    """Work off everything that arrived since the last call, then stop.

    ``raw_feeds`` is a streaming frame of (feed_id, fetched_at, body). The outside
    scheduler calls this; the checkpoint remembers what was read. With ``base_filters`` the
    ``base`` articles have their ``day`` as a partition column, and only days that may hold a URL are read.
    """
    return (
        raw_feeds.writeStream.foreachBatch(store_batch(feeds, base, provider, as_of, out, dim, base_filters))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
