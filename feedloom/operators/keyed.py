"""Tables kept in partitions by a hash of their key: look-ups and changes touch the partitions of their keys.

A row lies in the partition ``part_of`` its key, sorted by key, so that a look-up prunes to one partition and in it to
the row groups around the key. A change reads the partitions of the keys it names, stages their next state, and
replaces just them (dynamic partition overwrite); the files of all others stay as they are. Every change here
gives the same state when it is made again, so one that failed half-way is simply repeated.

Overwriting leaves a partition alone for which nothing is written. One that a change empties gets a row of
nulls instead, which ``rows`` leaves out; a null key therefore cannot be stored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.operators.constraints import split_embeddings
from feedloom.operators.embeddings import upsert_embeddings
from feedloom.operators.joins import few, if_few, keep_matching
from feedloom.operators.registry import requested_ids
from feedloom.session import staged

PART = "key_part"
ROWS_PER_PART = 100_000
MOST_PARTS = 1 << 14


def parts_for(rows: int) -> int:
    """A power of two, so that the number need not change with every insert."""
    return min(MOST_PARTS, 1 << max(4, (max(rows, 1) // ROWS_PER_PART).bit_length()))


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


@dataclass(frozen=True)
class Keyed:
    """Where a table lies, its key, and the number of partitions."""

    path: str
    key: str
    parts: int
    schema: T.StructType

    def part(self) -> Column:
        return part_of(F.col(self.key), self.parts)


def _write(frame: DataFrame, table: Keyed) -> None:
    """The range cut takes the key in: a large partition is written by several tasks."""
    cut = frame.repartitionByRange(PART, table.key).sortWithinPartitions(PART, table.key)
    cut.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(table.path)


def write_keyed(frame: DataFrame, key: str, path: str, parts: int | None = None) -> Keyed:
    """A new table. Rows without a key are refused."""
    table = Keyed(path, key, parts_for(frame.count()) if parts is None else parts, frame.schema)
    refused = F.raise_error(F.lit(f"a row without {key}")).cast("int")
    _write(frame.withColumn(PART, F.when(F.col(key).isNull(), refused).otherwise(table.part())), table)
    return table


def rows(spark: SparkSession, table: Keyed) -> DataFrame:
    """The table as it is now, with the partition of each row."""
    whole = T.StructType([*table.schema.fields, T.StructField(PART, T.IntegerType())])
    return spark.read.schema(whole).parquet(table.path).where(F.col(table.key).isNotNull())


def find(spark: SparkSession, table: Keyed, key: object) -> DataFrame:
    """At most one row, read from one partition."""
    wanted = spark.range(1).select(part_of(F.lit(key), table.parts).alias("part")).first()["part"]
    return rows(spark, table).where((F.col(PART) == wanted) & (F.col(table.key) == key)).drop(PART).limit(1)


def _parts(keys: DataFrame, table: Keyed) -> list[int]:
    """At most ``MOST_PARTS`` numbers."""
    return sorted(r["part"] for r in keys.select(table.part().alias("part")).distinct().collect())


def find_all(spark: SparkSession, table: Keyed, keys: DataFrame) -> DataFrame:
    """The rows whose key is in ``keys`` (one column of that name), read from the partitions of those keys. The
    join has the partition in its key, as the stored rows have."""
    asked = staged(keys.select(table.key).where(F.col(table.key).isNotNull()).distinct(), "asked-keys")
    near = rows(spark, table).where(F.col(PART).isin(_parts(asked, table))).drop(PART)
    return near.join(if_few(asked), table.key, "left_semi").select(table.schema.fieldNames())


def change(spark: SparkSession, table: Keyed, keys: DataFrame, after: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Replaces the partitions of ``keys`` by ``after`` of their rows, and names them.

    ``after`` may drop, alter and add rows whose key is in ``keys`` and has to keep the others.
    """
    touched = _parts(keys.where(F.col(table.key).isNotNull()), table)
    if not touched:
        return []
    current = rows(spark, table).where(F.col(PART).isin(touched)).drop(PART)
    made = staged(after(current).select(table.schema.fieldNames()).withColumn(PART, table.part()), "changed")
    left = {r[PART] for r in made.select(PART).distinct().collect()}
    if strange := left - set(touched):
        raise ValueError(f"the change gives rows of partitions {sorted(strange)[:5]}, which none of its keys is in")
    if emptied := [p for p in touched if p not in left]:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields]
        marks = spark.createDataFrame([(p,) for p in emptied], f"{PART} int").select(*nothing, PART)
        made = made.unionByName(marks)
    _write(made, table)
    return touched


def upsert_vectors(spark: SparkSession, table: Keyed, updates: DataFrame, dim: int) -> DataFrame:
    """Replaces or adds vectors by article (``upsert_embeddings``) and gives the updates that cannot be stored."""
    updates = staged(updates.select(table.schema.fieldNames()), "updates")
    good, rejected = split_embeddings(updates, dim)
    change(spark, table, good, lambda stored: upsert_embeddings(stored, updates, dim)[0])
    return rejected


def delete_keys(spark: SparkSession, table: Keyed, keys: DataFrame) -> list[int]:
    """``keys`` is read more than once: a written table."""
    return change(spark, table, keys, lambda stored: stored.join(if_few(keys.select(table.key)), table.key, "left_anti"))


def delete_feeds(spark: SparkSession, feeds: Keyed, articles: Keyed, embeddings: Keyed, requests: DataFrame) -> DataFrame:
    """Deletes feeds by (id) with their articles and those articles' vectors, and gives the ids not found.

    The feeds' articles are found by a scan of two columns. Vectors go first and feeds last, so that a
    deletion that failed half-way finds the rest when it is repeated.
    """
    asked = staged(requested_ids(requests), "asked-feeds")
    gone = staged(find_all(spark, feeds, asked).select("id"), "deleted-feeds")
    owners = gone.select(F.col("id").alias("feed_id"))
    lost = keep_matching(rows(spark, articles).select("id", "feed_id"), owners, "feed_id", spread_by=("id",), small=few(owners))
    lost = staged(lost.select("id"), "deleted-articles")
    delete_keys(spark, embeddings, lost.select(F.col("id").alias("article_id")))
    delete_keys(spark, articles, lost)
    delete_keys(spark, feeds, gone)
    return asked.join(if_few(gone), "id", "left_anti").select("id", F.lit("not_found").alias("reason"))
