"""Cosine similarity search: one query, and a table of queries.

Distances are products of whole Arrow batches with the query block: the built-in
higher-order functions visit one element at a time and are many times slower at
the usual 768 dimensions. Only ids and distances leave the Python workers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import rules
from feedloom.functions.text import is_blank
from feedloom.functions.vectors import distances, matrix
from feedloom.operators.enrich import Provider
from feedloom.operators.joins import few
from feedloom.operators.ranking import fetch
from feedloom.schemas import ARTICLE_COLUMNS
from feedloom.session import shared_folder, staged

# A query block of this many values is shipped to every task: 32 MB as doubles.
BLOCK_VALUES = 4_000_000
_ROWS_AT_ONCE = 2048
# Distances held at once by a worker: 32 MB as doubles, and a few copies of them.
_CELLS = 4_000_000
# Queries of a block from which the comparisons outweigh dealing out the vectors.
_MANY = 1000
# How many times k a search looks up before it takes vectors without an article
# for common.
SPARE = 4


def _nearest_first() -> list[Column]:
    # distance ascending and not similarity descending: NaN has to come last
    return [F.asc_nulls_last("distance"), F.asc("article_id")]


def distances_to(embeddings: DataFrame, query: Sequence[float]) -> DataFrame:
    """(article_id, distance) of every stored vector."""
    target = np.asarray(query, dtype=np.float64)[None, :]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = distances(matrix(batch.column(1), target.shape[1]), target)[:, 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["article_id", "distance"])

    return embeddings.select("article_id", "embedding").mapInArrow(measure, "article_id string, distance double")


def nearest(embeddings: DataFrame, query: Sequence[float], k: int, articles: DataFrame | None = None) -> DataFrame:
    """The k nearest (article_id, distance).

    With ``articles``, vectors without an article are left out and the article's
    time is given as well; that join moves ids, times and distances, never
    vectors.
    """
    scored = distances_to(embeddings, query)
    if articles is not None:
        scored = scored.join(articles.select(F.col("id").alias("article_id"), "created_at"), "article_id")
    return scored.orderBy(*_nearest_first()).limit(k)


def _hits(articles: DataFrame, embeddings: DataFrame, query: Sequence[float], k: int) -> list[tuple]:
    """(id, distance, created) of the k nearest vectors that have an article.

    Where deletes cascade every vector has one, so a few more vectors than needed
    are looked up first, a scan of two columns with an IN filter. Only if too many
    of them are orphans are all distances joined with the articles.
    """
    more = k * SPARE
    near = nearest(embeddings, query, more).collect()
    among = articles.where(F.col("id").isin([row["article_id"] for row in near]))
    micros = F.unix_micros("created_at").alias("micros")
    created = {row["id"]: row["micros"] for row in among.select("id", micros).collect()}
    hits = [(row["article_id"], row["distance"], created[row["article_id"]]) for row in near if row["article_id"] in created]
    if len(hits) < k and len(near) == more:
        joined = nearest(embeddings, query, k, articles)
        return [tuple(row) for row in joined.select("article_id", "distance", micros).collect()]
    return hits[:k]


def search(articles: DataFrame, embeddings: DataFrame, query: Sequence[float], limit: object = None) -> DataFrame:
    """The articles nearest to the query with their ``similarity_score``.

    The hits, 50 at most, come to the driver as ids and go back as filters on id
    and time: the wide columns of the other articles are not shuffled, and as
    articles are written in order of time the reader skips most of them unread.
    """
    hits = _hits(articles, embeddings, query, rules.hit_limit(limit))
    found = fetch(articles, [h[0] for h in hits], [h[2] for h in hits])
    if not hits:
        return found.withColumn("distance", F.lit(None).cast("double")).withColumn("similarity_score", F.col("distance"))
    by_id = F.create_map(*[F.lit(v) for h in hits for v in h[:2]])
    return (
        found.withColumn("distance", by_id[F.col("id")])
        .withColumn("similarity_score", 1 - F.col("distance"))
        .orderBy(F.asc_nulls_last("distance"), "id")
    )


def search_text(articles: DataFrame, embeddings: DataFrame, provider: Provider, text: str, limit: object = None) -> DataFrame:
    """``search`` for a query in words, embedded by the provider."""
    clean = rules.clean_query(text)
    spark = articles.sparkSession
    row = provider.embed(spark.createDataFrame([(clean,)], "text string")).first()
    if row["error"] is not None:
        raise RuntimeError(f"the query could not be embedded: {row['error']}")
    return search(articles, embeddings, row["embedding"], limit)


class Best:
    """The k best of each query so far, ties on distance decided by id.

    A row of ``values`` and ``places`` (in ``names``; -1 for none) belongs to a query, in order. Only the rows
    of queries with new candidates are touched, and ids are compared only where distances tie.
    """

    def __init__(self, limits: Sequence[int]):
        self.limits = np.asarray(limits, np.int64)
        self.most = int(self.limits.max(initial=0))
        self.worst = np.full(len(self.limits), np.inf)
        self.values = np.full((len(self.limits), self.most), np.inf)
        self.places = np.full((len(self.limits), self.most), -1, np.int64)
        self.names = np.empty(0, object)

    def add(self, ids: np.ndarray, found: np.ndarray, among: np.ndarray | None = None) -> None:
        """A block of vectors: their ids, and their distances with a column per query, or per
        query of ``among``, if only those met the block."""
        among = np.arange(len(self.limits)) if among is None else among
        found = np.where(np.isnan(found), np.inf, found)
        bound = self.worst[among]
        near = found <= bound[None, :]
        crowded = np.flatnonzero(near.sum(axis=0) > self.most)
        if len(crowded):
            # ties with the k-th value stay until the ids decide
            some = found[:, crowded]
            near[:, crowded] &= some <= np.partition(some, self.most - 1, axis=0)[self.most - 1]
        rows, columns = np.nonzero(near)
        used, place = np.unique(rows, return_inverse=True)
        self.merge(among[columns], found[rows, columns], ids[used], place)

    def merge(self, queries: np.ndarray, values: np.ndarray, ids: np.ndarray, place: np.ndarray) -> None:
        """Candidates: a query, a distance (inf for NaN) and the place of an id in ``ids``."""
        if not len(queries):
            return
        met, number = np.unique(queries, return_inverse=True)
        there = self.places[met] >= 0
        rows, columns = np.nonzero(there)
        number = np.concatenate([rows, number])
        values = np.concatenate([self.values[met][rows, columns], values])
        places = np.concatenate([self.places[met][rows, columns], place + len(self.names)])
        self.names = np.concatenate([self.names, ids])
        order = np.lexsort((values, number))
        number, values, places = number[order], values[order], places[order]
        same = (number[1:] == number[:-1]) & (values[1:] == values[:-1])
        if same.any():
            tied = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
            different, at = np.unique(places[tied], return_inverse=True)
            rank = np.unique(self.names[different], return_inverse=True)[1][at]
            places[tied] = places[tied][np.lexsort((rank, values[tied], number[tied]))]
        counts = np.bincount(number, minlength=len(met))
        column = np.arange(len(number)) - np.repeat(np.cumsum(counts) - counts, counts)
        kept = column < self.limits[met][number]
        self.values[met], self.places[met] = np.inf, -1
        self.values[met[number[kept]], column[kept]] = values[kept]
        self.places[met[number[kept]], column[kept]] = places[kept]
        full = counts >= self.limits[met]
        self.worst[met[full]] = self.values[met[full], self.limits[met[full]] - 1]
        if len(self.names) > 2 * self.places.size + _ROWS_AT_ONCE:
            self._forget()

    def _forget(self) -> None:
        """Names that no query keeps."""
        there = self.places >= 0
        used, place = np.unique(self.places[there], return_inverse=True)
        self.names, self.places[there] = self.names[used], place

    def batch(self, query_ids: Sequence) -> dict[str, list]:
        queries, columns = np.nonzero(self.places >= 0)
        values = self.values[queries, columns]
        return {
            "query_id": [query_ids[q] for q in queries.tolist()],
            "k": self.limits[queries].astype(np.int32),
            "article_id": self.names[self.places[queries, columns]].tolist(),
            "distance": np.where(np.isinf(values), np.nan, values),
        }


HITS = pa.schema([("query_id", pa.string()), ("k", pa.int32()), ("article_id", pa.string()), ("distance", pa.float64())])
HITS_DDL = "query_id string, k int, article_id string, distance double"


def feed(best: Best, ids: pa.Array, vectors: pa.Array, targets: np.ndarray, among: np.ndarray | None = None) -> None:
    """Meets the vectors in blocks of a bounded number of distances. ``targets`` are those of
    the queries in ``among``, or of all."""
    rows = max(1, min(_ROWS_AT_ONCE, _CELLS // max(1, len(targets))))
    for start in range(0, len(ids), rows):
        block = matrix(vectors.slice(start, rows), targets.shape[1])
        names = np.array(ids.slice(start, rows).to_pylist(), dtype=object)
        best.add(names, distances(block, targets), among)


def _with_shipped_queries(vectors: DataFrame, queries: pa.Table, dim: int) -> DataFrame:
    """The k best of each query and task. The vectors are read where they lie; for many queries they are
    dealt out first, so that all cores compare, whatever the files."""
    names = queries.column("query_id").to_pylist()
    limits = queries.column("k").to_pylist()
    targets = matrix(queries.column("embedding").combine_chunks(), dim)
    if len(names) >= _MANY:
        vectors = vectors.repartition("article_id")
    shipped = vectors.sparkSession.sparkContext.broadcast((names, limits, targets))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, limits, targets = shipped.value
        best = Best(limits)
        for batch in batches:
            feed(best, batch.column(0), batch.column(1), targets)
        yield pa.RecordBatch.from_pydict(best.batch(names), schema=HITS)

    return vectors.mapInArrow(scan, HITS_DDL)


def asked_of(queries: DataFrame) -> DataFrame:
    """(query_id, embedding, k) of a table of (query_id, embedding, requested)."""
    return queries.select(
        F.col("query_id").cast("string").alias("query_id"),
        "embedding",
        rules.hit_limit_column(F.col("requested")).alias("k"),
    )


def met(asked: DataFrame, dim: int, block_values: int, meet: Callable[[pa.Table], DataFrame]) -> DataFrame:
    """Hits of all queries. ``meet`` scans the vectors for one block of queries, whose size
    ``block_values`` bounds.

    A query table of that size is one block. A larger one is cut by a hash into blocks, and a
    block's hits are written before the next one is shipped. The vectors never move.
    """
    spark, block_rows = asked.sparkSession, max(1, block_values // dim)
    queries_asked = asked.count()
    if queries_asked == 0:
        return spark.createDataFrame([], HITS_DDL)
    if queries_asked <= block_rows:
        return meet(asked.toArrow())
    blocks = 2 * math.ceil(queries_asked / block_rows)  # half full on average
    path = shared_folder(spark, "batch-search")
    cut = staged(asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "queries")
    for number in range(blocks):
        block = cut.where(F.col("_block") == number).drop("_block").toArrow()
        if block.num_rows:
            meet(block).write.mode("append").parquet(path)
    return spark.read.schema(HITS_DDL).parquet(path)


def ranked(hits: DataFrame) -> DataFrame:
    """(query_id, rank, article_id, similarity_score) of the k best hits of each query."""
    order = Window.partitionBy("query_id").orderBy(*_nearest_first())
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= rules.MAX_HITS)  # a constant bound limits each task before the shuffle
        .where("rank <= k")
        .select("query_id", "rank", "article_id", (1 - F.col("distance")).alias("similarity_score"))
    )


def of_articles(embeddings: DataFrame, articles: DataFrame) -> DataFrame:
    """Vectors that have an article. The orphans are found by id; as long as they
    are few, no vector moves."""
    ids = articles.select(F.col("id").alias("article_id"))
    orphans = staged(embeddings.select("article_id").distinct().join(ids, "article_id", "left_anti"), "orphans")
    if few(orphans):
        return embeddings.join(F.broadcast(orphans), "article_id", "left_anti")
    return embeddings.join(ids, "article_id", "left_semi")


def batch_search(
    embeddings: DataFrame,
    queries: DataFrame,
    dim: int,
    articles: DataFrame | None = None,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """(query_id, rank, article_id, similarity_score) for a table of
    (query_id, embedding, requested), exact.

    Every block of queries (``met``) is shipped to the tasks that scan the vectors.
    """
    vectors = embeddings.select("article_id", "embedding")
    if articles is not None:
        vectors = of_articles(vectors, articles)
    return ranked(met(asked_of(queries), dim, block_values, lambda block: _with_shipped_queries(vectors, block, dim)))


def split_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Searches that can run, and the blank ones."""
    blank = is_blank(F.col("query"))
    return queries.where(~blank), queries.where(blank).withColumn("reason", F.lit("empty_query"))


def _rfc3339(when: Column) -> Column:
    """UTC, with as many fraction digits as needed."""
    text = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))


def article_document(article: DataFrame) -> Column:
    """The article as a JSON value: nulls are kept, an empty raw_content is not."""
    fields = {
        "published_at": _rfc3339(F.col("published_at")),
        "created_at": _rfc3339(F.col("created_at")),
    }
    columns = [fields.get(c, F.col(c)).alias(c) for c in ARTICLE_COLUMNS]
    return F.struct(*columns)


def result_documents(hits: DataFrame) -> DataFrame:
    """One JSON document per hit, in rank order."""
    article = article_document(hits)
    full = F.to_json(F.struct(article.alias("article"), "similarity_score"), {"ignoreNullFields": "false"})
    bare = F.to_json(
        F.struct(article.dropFields("raw_content").alias("article"), "similarity_score"), {"ignoreNullFields": "false"}
    )
    empty = F.coalesce(F.col("raw_content"), F.lit("")) == ""
    return hits.select("id", "distance", F.when(empty, bare).otherwise(full).alias("document"))


def response(hits: DataFrame, query: str) -> DataFrame:
    """The answer to one search: query, number of hits and the hits, as one row.
    The hits are 50 at most."""
    documents = result_documents(hits)
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("distance", F.lit(math.nan)).alias("d"), "id", "document")))
    return documents.agg(F.count("*").alias("count"), ranked.alias("ranked")).select(
        F.lit(query).alias("query"),
        "count",
        F.transform("ranked", lambda r: r["document"]).alias("results"),
    )
