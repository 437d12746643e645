"""Mixing sources to target weights by pivotal dependent rounding.

Every document gets the expected number of copies ``target / source size``. The whole part
is given outright. The fractional parts are rounded in pairs: mass, measured in words, goes
from one document to the other at random, in the proportion that keeps both expectations,
until one of the two fractions is 0 or 1; the other one meets the next document. So the
expected words of a source are met up to one last document. Pairs meet in blocks of
bounded size, each leaves one fraction, and the fractions that are left meet in blocks again, level
by level, until one per source is rounded on its own; the words that this adds or takes are given
back by smaller documents of the last block.

Draws are hashes of the id, size and level, so a rerun or a retried task gives the same.
Null text has size 0 and a null source is a source of its own, the last one. Documents of
size 0 cost nothing and get whole copies only. Rows that repeat an id are rounded each on its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from feedloom.llm.common import SPACE, key_text, staged
from feedloom.operators.joins import attach

#: Documents that meet in one block, on average.
BLOCK = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
SEED = 20240101
_TINY = 1e-9

_ROW = ["doc_id", "row", "ordinal", "source_key", "size", "peers", "copies", "fraction"]


def word_count(text: Column) -> Column:
    """Words of a text: what is left between runs of white space."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")
    spaces = F.length(inner) - F.length(F.replace(inner, F.lit(" "), F.lit("")))
    edges = F.startswith(inner, F.lit(" ")).cast("int") + F.endswith(inner, F.lit(" ")).cast("int")
    return F.when((inner == "") | (inner == " "), F.lit(0)).otherwise(spaces + 1 - edges).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``place``, from 0 by code point, null last.

    Sorted by range over many tasks: a place is the place in its part and the sizes of the
    parts before, of which there is one number per part.
    """
    order = F.col("source").isNull(), F.col("source")
    sorted_ = sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    step = F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)
    ordered = staged(sorted_.withColumn("step", step), "ranked")
    sizes = {r["part"]: r["n"] for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, {}
    for part in sorted(sizes):
        offsets[part] = before
        before += sizes[part]
    if not offsets:
        return ordered.withColumn("place", F.col("step")).drop("part", "step")
    shift = F.create_map(*[F.lit(x).cast("long") for item in offsets.items() for x in item])
    return ordered.withColumn("place", F.col("step") + shift[F.col("part").cast("long")]).drop("part", "step")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_key, n, source_size) with ``target``.

    ``level`` is what one unit of weight gets. It rises while capped sources give back their
    excess, and stops when no further source is above its cap.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = ranked(sources).withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int")))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    rows = staged(rows, "sources")
    whole = rows.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("weight"), F.count("*").alias("n")).first()
    if not whole["n"]:
        return rows.withColumn("target", F.lit(0.0))
    mass = share * whole["all"]
    level, capped = mass / whole["weight"], -1
    while True:
        above = F.col("weight") * level > F.col("cap")
        found = rows.agg(
            F.sum(F.when(above, 1).otherwise(0)).alias("n"),
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("cap"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if found["n"] == capped or not found["free"]:
            break
        level, capped = (mass - found["cap"]) / found["free"], found["n"]
    return rows.withColumn("target", F.least(F.col("weight") * level, F.col("cap"))).drop("place", "weight", "cap")


def pivotal(sizes: np.ndarray, fractions: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The fractions after all pairs have met in order: 0 or 1, but for one at most."""
    result = fractions.astype(float).copy()
    at = -1
    for i, (w, p, u) in enumerate(zip(sizes.tolist(), fractions.tolist(), draws.tolist())):
        if at < 0:
            at, have, q = i, w, p
            continue
        up = min((1 - q) * have, p * w)  # words that may move to the one that waits
        down = min(q * have, (1 - p) * w)  # and from it
        moved = up if u * (up + down) < down else -down
        q, p = q + moved / have, p - moved / w
        q = 0.0 if q < _TINY else 1.0 if q > 1 - _TINY else q
        p = 0.0 if p < _TINY else 1.0 if p > 1 - _TINY else p
        if 0 < q < 1:
            result[i] = p
        else:
            result[at] = q
            at, have, q = (i, w, p) if 0 < p < 1 else (-1, 0, 0.0)
            if at < 0:
                result[i] = p
    if at >= 0:
        result[at] = q
    return result


def settled(sizes: np.ndarray, fractions: np.ndarray, draws: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The last fraction rounded, and the words that this adds or takes given back by smaller
    documents of the block, the largest that fit first."""
    left = (after > 0) & (after < 1)
    after = np.where(left, draws < after, after).astype(float)
    over = float((after * sizes).sum() - (fractions * sizes).sum())
    for i in np.lexsort((draws, -sizes)).tolist():
        if not left[i] and after[i] == (over > 0) and sizes[i] <= abs(over):
            after[i] = 1.0 - after[i]
            over += sizes[i] if after[i] else -sizes[i]
    return after


def _round(last: bool):
    def block(met: pa.Table) -> pa.Table:
        sizes, fractions, draws = (met[c].to_numpy() for c in ("size", "fraction", "draw"))
        # large documents first, so that what is left over is small
        order = np.lexsort((met["ordinal"].to_numpy(), met["row"].to_numpy(), draws, -sizes))
        after = np.empty(len(order))
        after[order] = pivotal(sizes[order], fractions[order], draws[order])
        if last:
            after = settled(sizes, fractions, draws, after)
        whole = after >= 1
        copies = met["copies"].to_numpy() + whole.astype(np.int32)
        columns = {c: met[c] for c in _ROW} | {"copies": pa.array(copies), "fraction": pa.array(np.where(whole, 0.0, after))}
        return pa.table(columns)

    return block


def rounded(rows: DataFrame, most_rows: int, block: int = BLOCK) -> DataFrame:
    """The rows with every fraction rounded into ``copies``.

    ``peers`` is the number of rows of the source, ``most_rows`` that of the largest source,
    which sets the depth of the tree.
    """
    done, waiting, level = [], rows.select(*_ROW), 0
    while True:
        last = most_rows <= block
        met = waiting.filter(F.col("fraction") > 0)
        parts = F.greatest(F.ceil(F.col("peers") / block), F.lit(1)).cast("long")
        chance = F.xxhash64(F.lit(SEED + level), "doc_id", "row", "ordinal")
        met = met.withColumn("peers", parts).withColumn("part", F.pmod(F.xxhash64(F.lit(level), "doc_id", "row", "ordinal"), F.col("peers")))
        met = met.withColumn("draw", F.shiftrightunsigned(chance, 11) / float(1 << 53))
        met = met.groupBy("source_key", "part").applyInArrow(_round(last), waiting.schema)
        met = staged(waiting.filter(F.col("fraction") == 0).unionByName(met), f"mixed-{level}")
        done.append(met.filter(F.col("fraction") == 0))
        if last:
            break
        waiting, most_rows, level = met.filter(F.col("fraction") > 0), -(-most_rows // block), level + 1
    return reduce(DataFrame.unionByName, done).drop("peers", "fraction")


def _row_hash(docs: DataFrame) -> Column:
    """Tells rows apart; rows that agree in all plain columns are copies of one another."""
    return F.xxhash64(*[F.col(f.name) for f in docs.schema if isinstance(f.dataType, AtomicType)])


def planned(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id``, ``row``, ``ordinal``, ``source``, ``size``, ``source_size``, ``target``, ``copies``.

    ``row`` is a hash of the whole row and ``ordinal`` numbers equal rows.
    """
    sized = docs.select("doc_id", "source", word_count(docs["text"]).alias("size"), _row_hash(docs).alias("row"))
    counted = staged(sized.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("n")), "sizes")
    key = key_text(F.col("source")).alias("source_key")
    rows = counted.select("doc_id", "row", key, "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("ordinal"))
    sources = counted.groupBy("source", key).agg(F.sum("n").alias("peers"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    aims = staged(targets(sources, weights, share, most), "targets")
    most_rows = aims.agg(F.max("peers").alias("n")).first()["n"] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    wide = attach(rows, aims.select("source_key", "peers", ratio.alias("ratio")), "source_key", ("row", "ordinal"))
    whole = F.floor(F.col("ratio") + _TINY)
    left = F.col("ratio") - whole
    fraction = F.when((left < _TINY) | (F.col("size") == 0), F.lit(0.0)).otherwise(left)
    start = wide.withColumn("copies", whole.cast("int")).withColumn("fraction", fraction)
    result = rounded(start, most_rows, block)
    return attach(result, aims.select("source_key", "source", "source_size", "target"), "source_key", ("row", "ordinal")).drop("source_key")


def report(docs: DataFrame) -> DataFrame:
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return planned(docs).select("doc_id", "size", "source_size", "target", taken, "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix: every document as often as its copies say, with all its columns."""
    plan = planned(docs, **options).groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__hash"))
    plan = staged(plan.agg(F.sum("copies").alias("__copies"), F.count("*").alias("__n")).filter("__copies > 0"), "copies")
    rows = docs.withColumn("__row", _row_hash(docs))
    names = [F.col(c) for c in docs.columns]

    def times(rows: DataFrame, plan: DataFrame) -> DataFrame:
        same = rows["doc_id"].eqNullSafe(plan["__id"]) & (rows["__row"] == plan["__hash"])
        return rows.join(plan, same).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")).drop("__copy")

    equal = plan.filter("__n > 1")
    if equal.isEmpty():
        return times(rows, plan)
    # rows written several times stand for one another: one of them, as often as all together
    return times(rows, plan.filter("__n = 1")).unionByName(times(rows.join(equal, rows["__row"] == equal["__hash"], "left_semi").dropDuplicates(["doc_id", "__row"]), equal))
