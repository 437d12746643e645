"""Exact duplicates of a batch against an immutable snapshot.

The digests of the snapshot are cut into shards of a bounded number of keys, and each
shard gets a static binary-fuse filter. Incoming digests are grouped among themselves
first (duplicates inside the batch), then screened: a digest the filter does not know is
new and never meets the snapshot; the others join the exact buckets. Texts of equal
digest are compared byte for byte before anything is dropped, and a digest shared by
different texts is taken apart by text.

Of equal texts the row with the largest ``doc_id`` stays; a null id is smaller than any.
Null text counts as empty, and empty texts are equal to each other. Rows that repeat both
id and text are told apart by number only: exactly one of them stays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm import fuse
from feedloom.llm.common import staged
from feedloom.operators.joins import attach, few, if_few, keep_matching

#: Keys of a filter, on average; 16 bits and an eighth more for each.
SHARD_KEYS = 1_000_000

_FILTER = "shard int, seed int, length int, segments int, cells binary"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _key(digest: Column) -> Column:
    return F.xxhash64(digest)


def build_filters(digests: DataFrame, shards: int) -> DataFrame:
    """One filter per shard of the distinct ``digest`` values."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        seed, length, segments, cells = fuse.build(rows["key"].to_numpy())
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "seed": seed, "length": length, "segments": segments, "cells": [cells.tobytes()]})

    keys = digests.select(_key(F.col("digest")).alias("key")).select("key", _shard(shards))
    return keys.groupBy("shard").applyInPandas(one, _FILTER)


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftright("key", 7), F.lit(shards)).cast("int").alias("shard")


def screen(groups: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """``groups`` (one row per ``digest``) with ``maybe``: whether the snapshot may hold the digest."""
    keyed = groups.withColumn("key", _key(F.col("digest"))).select("*", _shard(shards))
    columns = groups.columns

    def ask(asked: pa.Table, found: pa.Table) -> pa.Table:
        known = np.zeros(asked.num_rows, bool)
        if found.num_rows and asked.num_rows:
            f = found.to_pylist()[0]
            known = fuse.contains(asked["key"].to_numpy(), f["seed"], f["length"], f["segments"], np.frombuffer(f["cells"], np.uint16))
        return asked.select(columns).append_column("maybe", pa.array(known))

    schema = groups.withColumn("maybe", F.lit(True)).schema
    return keyed.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(ask, schema)


def _grouped(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def buckets(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per digest of either side: ``keep_id`` and ``group_size`` over both."""
    stored, arrived = _grouped(snapshot), _grouped(batch)
    shards = 1 + max(snapshot.count(), batch.count()) // SHARD_KEYS
    screened = staged(screen(arrived, build_filters(stored, shards), shards), "screened")
    unknown = screened.filter(~F.col("maybe")).drop("maybe")
    asked = screened.filter("maybe").select("digest", F.col("keep_id").alias("new_id"), F.col("group_size").alias("new_size"))
    met = stored.join(asked, "digest", "full").select(
        "digest",
        F.greatest("keep_id", "new_id").alias("keep_id"),
        (F.coalesce("group_size", F.lit(0)) + F.coalesce("new_size", F.lit(0))).alias("group_size"),
    )
    return met.unionByName(unknown)


def _texts(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    return rows.select("doc_id", "text", digest(F.col("text")).alias("digest"))


def _same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    result = F.lit(True)
    for name in names:
        result = result & left[name].eqNullSafe(right[name])
    return result


def classify(docs: DataFrame, in_snapshot: Column, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: ``doc_id``, ``digest``, ``keep_id``, ``group_size``, ``kept``.

    ``in_snapshot`` says which rows are stored already; null means no. A digest may be
    any function of the text: collisions cost time, never rows.
    """
    marked = docs.select("doc_id", "text", F.coalesce(in_snapshot, F.lit(False)).alias("stored"))
    text = F.coalesce("text", F.lit(""))
    digests = staged(marked.select("doc_id", digest(text).alias("digest"), "stored"), "digests")
    groups = staged(buckets(digests.filter("stored"), digests.filter(~F.col("stored"))), "buckets")
    members = digests.drop("stored")
    # bytes of the candidates only; copies meet as one row per task
    shared = staged(groups.filter("group_size > 1").select("digest"), "shared")
    rows, small = _texts(docs, digest), few(shared)
    if small:
        compared = rows.join(F.broadcast(shared), "digest", "left_semi")
    else:
        candidates = keep_matching(members, shared, "digest", ("doc_id",), small).distinct()
        compared = rows.join(candidates, _same(rows, candidates, "doc_id", "digest"), "left_semi")
    variants = staged(compared.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).select("digest", F.sha2(F.col("text").cast("binary"), 256).alias("content"), "keep_id", "group_size"), "variants")
    mixed = variants.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1").select("digest")
    if mixed.isEmpty():
        placed = attach(members, groups, "digest", ("doc_id",))
    else:
        alone = members.join(mixed, "digest", "left_anti").join(groups, "digest")
        apart = rows.join(mixed, "digest", "left_semi").select("doc_id", "digest", F.sha2(F.col("text").cast("binary"), 256).alias("content"))
        placed = alone.unionByName(apart.join(variants, ["digest", "content"]).drop("content"))
    return _one_stays(placed)


def _one_stays(placed: DataFrame) -> DataFrame:
    """Equal rows are counted, and the copies written out again with one of them kept."""
    counted = placed.groupBy("doc_id", "digest", "keep_id", "group_size").agg(F.count("*").cast("int").alias("copies"))
    numbered = counted.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return numbered.select("doc_id", "digest", "keep_id", "group_size", "copies", stays.alias("kept"))


def kept(docs: DataFrame, in_snapshot: Column, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The documents that stay, with all their columns.

    Of rows that repeat id and text one stays, chosen by the hash of all its columns.
    """
    judged = classify(docs, in_snapshot, digest).groupBy(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    judged = staged(judged.agg(F.max("kept").alias("__kept"), F.max("copies").alias("__copies")), "judged")
    rows = docs.withColumn("__own", digest(F.coalesce(docs["text"], F.lit(""))))
    names = [F.col(c) for c in docs.columns]

    def of(ids: DataFrame, how: str) -> DataFrame:
        # few ids are broadcast, and the texts stay where they are
        ids = if_few(ids.select("__id", "__digest"))
        return rows.join(ids, rows["doc_id"].eqNullSafe(ids["__id"]) & (rows["__own"] == ids["__digest"]), how).select(*names, "__own")

    once = of(judged.filter("NOT __kept OR __copies > 1"), "left_anti").select(*names)
    twice = judged.filter("__kept AND __copies > 1")
    if twice.isEmpty():
        return once
    written = of(twice, "left_semi").withColumn("__hash", F.xxhash64(*names)).dropDuplicates(["doc_id", "__own", "__hash"])
    least = written.groupBy(F.col("doc_id").alias("__id"), F.col("__own").alias("__digest")).agg(F.min("__hash").alias("__least"))
    same = written["doc_id"].eqNullSafe(least["__id"]) & (written["__own"] == least["__digest"]) & (written["__hash"] == least["__least"])
    return once.unionByName(written.join(least, same, "left_semi").select(*names))


def earlier_half(docs: DataFrame) -> Column:
    """Documents stored already: ids up to the middle of their range. Ids grow with arrival."""
    ends = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if ends["low"] is None:
        return F.lit(False)
    return F.col("doc_id") <= (ends["low"] + ends["high"]) // 2


def report(docs: DataFrame) -> DataFrame:
    return classify(docs, earlier_half(docs)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
