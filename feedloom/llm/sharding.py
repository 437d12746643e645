"""Sharding by fixed virtual slots.

A record is hashed into one of ``SLOTS`` virtual slots, for good. The bytes of each slot are
added up, and a small versioned map says which shard holds which slot. Version 0 deals the
slots out in turn; every later version is an edit of the one before that moves whole slots
from shards with too many bytes to those with too few (``rebalanced``), or into a new shard
only (``grown``). Texts never move: the job carries id, size and checksum of each row, and
the driver sees one figure per slot.

A slot that is too heavy for that, as one id or group of copies that holds a third of the
bytes makes it, is split into parts. A row's part is a hash of its number, so that rows with equal
columns part as well; the map then names a shard for each part of the slot.

Null text has 0 bytes and counts 1 like every record, and the checksum of the empty text. Null
ids and repeated rows are records like any other. Shards and sizes do not depend on the order of
ties; equal rows may swap their places in a shard. No rows: no result rows, and the
first map stays. Further columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import staged
from feedloom.operators.joins import if_few
from feedloom.session import shared_folder

SHARDS = 16
SLOTS = 4096
#: A slot of more than this share of a shard's fair bytes is split into parts of at most so many.
SPLIT = 1 / 32
_MAP = "version int, slot int, part int, shard int"


@dataclass(frozen=True)
class SlotMap:
    """``owner[i]`` is the shard of entry i, which is part ``part[i]`` of slot ``slot[i]``."""

    version: int
    shards: int
    slot: np.ndarray
    part: np.ndarray
    owner: np.ndarray


def first_map(shards: int = SHARDS, slots: int = SLOTS) -> SlotMap:
    slot = np.arange(slots)
    return SlotMap(0, shards, slot, np.zeros(slots, int), slot % shards)


def split(found: SlotMap, parts: dict[int, int]) -> SlotMap:
    """The map with so many parts for some slots; all parts stay where their slot was."""
    whole = dict(zip(found.slot[found.part == 0].tolist(), found.owner[found.part == 0].tolist()))
    rows = [(s, p, whole[s]) for s in sorted(whole) for p in range(parts.get(s, 1))]
    slot, part, owner = (np.array(x, int) for x in zip(*rows))
    return replace(found, slot=slot, part=part, owner=owner)


def loads(found: SlotMap, weights: np.ndarray) -> np.ndarray:
    return np.bincount(found.owner, weights, found.shards).astype(np.int64)


def rebalanced(found: SlotMap, weights: np.ndarray) -> SlotMap:
    """The next version, with near equal bytes. ``weights`` are the bytes of the entries.

    Shards above the mean give up entries, the largest first that leave them at the mean or above;
    the entries given up go, largest first, to the lightest shard; then single entries move from
    the heaviest to the lightest shard while that brings the two closer.
    """
    owner, load = found.owner.copy(), loads(found, weights)
    mean = load.sum() / found.shards
    order = np.lexsort((np.arange(len(weights)), -weights))
    free = []
    for i in order.tolist():
        if weights[i] and load[owner[i]] - weights[i] >= mean:
            load[owner[i]] -= weights[i]
            free.append(i)
    for i in free:
        owner[i] = int(load.argmin())
        load[owner[i]] += weights[i]
    while True:
        high, low = int(load.argmax()), int(load.argmin())
        gap = load[high] - load[low]
        own = np.flatnonzero((owner == high) & (weights > 0) & (weights < gap))
        if not len(own):
            break
        i = own[np.abs(2 * weights[own] - gap).argmin()]
        owner[i] = low
        load[high] -= weights[i]
        load[low] += weights[i]
    return replace(found, version=found.version + 1, owner=owner)


def grown(found: SlotMap, weights: np.ndarray) -> SlotMap:
    """The next version with one more shard, which takes entries from the heaviest shards up to
    its fair share. No entry moves between the older shards."""
    owner = found.owner.copy()
    load = np.append(loads(found, weights), 0)
    mean = load.sum() / (found.shards + 1)
    for i in np.lexsort((np.arange(len(weights)), -weights)).tolist():
        fits = load[found.shards] + weights[i] <= mean and load[owner[i]] - weights[i] >= mean * (1 - SPLIT)
        if weights[i] and fits:
            load[owner[i]] -= weights[i]
            owner[i] = found.shards
            load[found.shards] += weights[i]
    return replace(found, version=found.version + 1, shards=found.shards + 1, owner=owner)


def write_map(spark: SparkSession, found: SlotMap, folder: str) -> None:
    """Add a version to the stored maps. Versions are written once and never changed."""
    rows = [(found.version, int(s), int(p), int(o)) for s, p, o in zip(found.slot, found.part, found.owner)]
    spark.createDataFrame(rows, _MAP).coalesce(1).write.parquet(f"{folder}/{found.version}")


def read_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """``slot`` and the shards of its parts, in order."""
    rows = spark.read.schema(_MAP).parquet(f"{folder}/{version}")
    ordered = F.array_sort(F.collect_list(F.struct("part", "shard")))
    return rows.groupBy("slot").agg(ordered.alias("ordered")).select(F.col("slot").alias("virtual_slot"), F.col("ordered.shard").alias("owners"))


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``virtual_slot`` of every row, and where it lies: ``block`` and
    ``row``, its number. Written once, so that a row keeps its number when a task runs again."""
    text = F.coalesce(docs["text"].cast("binary"), F.lit(b""))
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.spark_partition_id().alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    slot = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")
    return staged(rows.withColumn("virtual_slot", slot), "slotted")


def part_of(parts) -> F.Column:
    return F.pmod(F.xxhash64("row"), parts).cast("int")


def slot_bytes(rows: DataFrame, found: SlotMap) -> tuple[SlotMap, np.ndarray]:
    """The map, with heavy slots split, and the bytes of its entries. The driver gets a row per
    slot, then one per part of the split slots: at most ``SLOTS`` and ``shards / SPLIT`` of them."""
    by_slot = {r["virtual_slot"]: r["bytes"] for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}
    most = max(1.0, SPLIT * sum(by_slot.values()) / found.shards)
    parts = {s: int(-(-n // most)) for s, n in by_slot.items() if n > most}
    divided = split(found, parts)
    by_entry = {(s, 0): n for s, n in by_slot.items() if s not in parts}
    if parts:
        few = rows.sparkSession.createDataFrame(sorted(parts.items()), "virtual_slot int, parts int")
        heavy = rows.join(F.broadcast(few), "virtual_slot").withColumn("part", part_of(F.col("parts")))
        by_part = heavy.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes")).collect()
        by_entry |= {(r["virtual_slot"], r["part"]): r["bytes"] for r in by_part}
    keys = zip(divided.slot.tolist(), divided.part.tolist())
    return divided, np.array([by_entry.get(k, 0) for k in keys], np.int64)


def placed(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """``rows`` with the ``shard`` that a stored map names. The map is broadcast: its size is bounded."""
    found = rows.join(F.broadcast(owners), "virtual_slot")
    return found.withColumn("shard", F.get("owners", part_of(F.size("owners")))).drop("owners")


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``slot``, the place in the shard, gapless from 0: the place among the shard's rows of
    one block, and the rows of the blocks before. No task sees more than a block of rows of a shard."""
    sizes = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("row"))
    inside = rows.withColumn("place", place)
    joined = inside.join(if_few(staged(offsets, "shard-offsets")), ["shard", "block"])
    return joined.withColumn("slot", F.col("before") + F.col("place") - 1).drop("before", "place")


def report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    spark = docs.sparkSession
    rows, folder = slotted(docs), shared_folder(spark, "slot-map")
    start = first_map(shards)
    write_map(spark, start, folder)
    current = rebalanced(*slot_bytes(rows, start))
    write_map(spark, current, folder)
    out = numbered(placed(rows, read_map(spark, folder, current.version)))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(current.version).alias("map_version"),
    )
