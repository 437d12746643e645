"""Approximate search: vectors filed by the side of a few fixed planes they lie on.

The bucket is a partition column, so a search reads a few directories only. The
number of planes follows from the number of vectors (about its square root of buckets), and
the sizes of the buckets are stored beside them: a search takes buckets in the
order of their distance until they hold the wanted number of candidates, a share
of all vectors that shrinks as there are more of them. One row per vector, however
many buckets are probed, and no bucket is ever gathered in one task: one that holds a
third of all vectors is just more files.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.vectors import matrix
from feedloom.operators.search import BLOCK_VALUES, HITS, HITS_DDL, Best, asked_of, feed, met, nearest, ranked
from feedloom.session import staged

#: Directories stay manageable.
MOST_BITS = 16


def bits_for(rows: int) -> int:
    """Planes for so many vectors: half the binary digits of their number."""
    return min(MOST_BITS, max(1, math.ceil(math.log2(max(rows, 2)) / 2)))


def candidates_for(rows: int, k: int) -> int:
    """Vectors to look at: 30 % of 2,000, 6 % of a million, 1 % of a billion."""
    return max(10 * k, math.ceil(2 * rows**0.75))


def planes(bits: int, dim: int) -> np.ndarray:
    """Plane normals from a rule, the same in every process: sin(0.6180339887 n^2)."""
    n = np.arange(1, bits * dim + 1, dtype=np.float64)
    return np.sin(n * n * 0.6180339887).reshape(bits, dim)


def index_embeddings(embeddings: DataFrame, dim: int, bits: int) -> DataFrame:
    """(article_id, embedding, bucket)."""
    normals = planes(bits, dim)
    weights = 1 << np.arange(bits)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = matrix(batch.column(1), dim) @ normals.T >= 0
            bucket = pa.array((sides * weights).sum(axis=1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bucket], ["article_id", "embedding", "bucket"])

    return embeddings.select("article_id", "embedding").mapInArrow(
        file, "article_id string, embedding array<float>, bucket int"
    )


@dataclass(frozen=True)
class Index:
    vectors: DataFrame
    sizes: dict[int, int]  # of the buckets that are not empty
    bits: int

    @property
    def rows(self) -> int:
        return sum(self.sizes.values())


def write_index(embeddings: DataFrame, dim: int, path: str) -> None:
    """Partitioned by bucket. The range cut takes the id in, so that a large
    bucket is written by several tasks and a small one into one file."""
    spark, bits = embeddings.sparkSession, bits_for(embeddings.count())
    filed = index_embeddings(embeddings, dim, bits).repartitionByRange("bucket", "article_id")
    filed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/vectors")
    sizes = spark.read.parquet(f"{path}/vectors").groupBy("bucket").agg(F.count("*").alias("n"))
    sizes.withColumn("bits", F.lit(bits)).write.mode("overwrite").parquet(f"{path}/sizes")


def open_index(spark: SparkSession, path: str) -> Index:
    """A written index. The driver keeps one number per bucket, 65,536 at most."""
    rows = spark.read.parquet(f"{path}/sizes").collect()
    return Index(spark.read.parquet(f"{path}/vectors"), {r["bucket"]: r["n"] for r in rows}, rows[0]["bits"] if rows else 1)


def _probed(sizes: dict[int, int], normals: np.ndarray, vector: np.ndarray, wanted: int) -> list[int]:
    bits = np.arange(len(normals))
    margins = normals @ vector
    home = int(((margins >= 0) * (1 << bits)).sum())
    filled = np.array(sorted(sizes), dtype=np.int64)
    crossed = (filled[:, None] ^ home) >> bits & 1
    cost = np.round((crossed * margins**2).sum(axis=1), 12)
    order = filled[np.lexsort((filled, cost))]
    before = np.cumsum([0, *(sizes[b] for b in order.tolist())])[:-1]
    return order[before < wanted].tolist()


def buckets_to_probe(index: Index, query: Sequence[float], wanted: int) -> list[int]:
    """Buckets by the squared distance of the planes between them and the query,
    until they hold the wanted number of vectors."""
    vector = np.asarray(query, dtype=np.float64)
    return _probed(index.sizes, planes(index.bits, len(vector)), vector, wanted)


def search_index(index: Index, query: Sequence[float], k: int, wanted: int | None = None) -> DataFrame:
    """The k nearest (article_id, distance) among the probed buckets, re-ranked exactly."""
    wanted = candidates_for(index.rows, k) if wanted is None else max(wanted, k)
    probed = buckets_to_probe(index, query, wanted)
    return nearest(index.vectors.where(F.col("bucket").isin(probed)), query, k)


def probes(index: Index, asked: DataFrame, dim: int, wanted: int | None = None) -> DataFrame:
    """(query_id, embedding, k, buckets): what each query of a table probes. The sizes of the buckets go
    to the tasks, one number per bucket."""
    sizes, bits, rows = dict(index.sizes), index.bits, index.rows
    normals = planes(bits, dim)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            limits = batch["k"].to_pylist()
            targets = matrix(batch["embedding"], dim)
            chosen = [_probed(sizes, normals, v, candidates_for(rows, k) if wanted is None else max(wanted, k)) for v, k in zip(targets, limits)]
            columns = [*batch.columns, pa.array(chosen, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "embedding", "k", "buckets"])

    return asked.select("query_id", "embedding", "k").mapInArrow(
        choose, "query_id string, embedding array<float>, k int, buckets array<int>"
    )


def _within_buckets(vectors: DataFrame, queries: pa.Table, dim: int) -> DataFrame:
    """The k best of each query and task. A vector meets the queries that probe its bucket."""
    names, limits = queries.column("query_id").to_pylist(), queries.column("k").to_pylist()
    targets = matrix(queries.column("embedding").combine_chunks(), dim)
    asking: dict[int, list[int]] = {}
    for number, buckets in enumerate(queries.column("buckets").to_pylist()):
        for bucket in buckets:
            asking.setdefault(bucket, []).append(number)
    shipped = vectors.sparkSession.sparkContext.broadcast((names, limits, targets, asking))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, limits, targets, asking = shipped.value
        best = Best(limits)
        for batch in batches:
            filed = np.asarray(batch.column(2))
            for bucket in np.unique(filed).tolist():
                among = np.array(asking.get(bucket, []), dtype=np.int64)
                if len(among):
                    own = batch.take(pa.array(np.flatnonzero(filed == bucket)))
                    feed(best, own.column(0), own.column(1), targets[among], among)
        yield pa.RecordBatch.from_pydict(best.batch(names), schema=HITS)

    some = vectors.where(F.col("bucket").isin(sorted(asking))).select("article_id", "embedding", "bucket")
    return some.mapInArrow(scan, HITS_DDL)


def search_index_batch(
    index: Index, queries: DataFrame, dim: int, wanted: int | None = None, block_values: int = BLOCK_VALUES
) -> DataFrame:
    """``batch_search`` over a written index: (query_id, rank, article_id, similarity_score) among the
    buckets that each query probes, re-ranked exactly. Only probed buckets are read, and a
    vector is compared with the queries that probe its bucket, not with all of them."""
    chosen = staged(probes(index, asked_of(queries), dim, wanted), "probes")
    return ranked(met(chosen, dim, block_values, lambda block: _within_buckets(index.vectors, block, dim)))
