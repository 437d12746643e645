"""Approximate search over navigable small-world graphs, one for each shard of the vectors.

A shard is a bounded number of vectors, picked by a hash of their id, and one row of the stored graph: ids,
vectors, and the edge list of every node. Nodes enter the graph in that order, which is as good as random, in steps that double
it. A node gets edges to near nodes that are there already, of which one that lies closer to a
chosen neighbour than to the node is left for later, so that edges point in different directions; the
first nodes thereby get the long edges that lead across. Every edge may be walked both ways, up to twice
``LINKS`` edges a node. Nodes that no walk would reach are kept as further entries.

A search starts at a shard's entries and keeps the ``EFFORT`` best nodes it has seen; the best whose edges
have not been followed are followed next, until none is left. All queries of a block walk at the same time, as
array operations. Distances are then computed exactly for the nodes kept, and the k best of all shards are
the result. Shards are read where they lie; no vector is shuffled by a search.

With ``EFFORT`` nodes or fewer in a shard the search is exact. A vector of norm zero is last, as its
distance is NaN. ``article_id`` is the key of the embeddings, one row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions.vectors import distances, matrix
from feedloom.operators.search import BLOCK_VALUES, HITS, HITS_DDL, Best, asked_of, met, ranked

#: Edges that a node chooses, nodes kept by a search, and vectors of a shard.
LINKS = 16
EFFORT = 128
SHARD_ROWS = 8192
_ENTRIES = 64
_STEP = 256
_WALKERS = 256
_FOLLOWED = 4

_SHARD = "shard int, article_ids array<string>, vectors array<float>, sizes array<int>, links array<int>, entries array<int>"


def _units(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return (vectors / np.where(norms == 0, 1, norms)).astype(np.float32)


def _spread(units: np.ndarray, near: np.ndarray, closeness: np.ndarray, most: int) -> np.ndarray:
    """Which of the candidates ``near`` (node, candidate; nearest first, -1 for none) become
    neighbours: those closer to the node than to any chosen before, then the nearest of the others."""
    among = units[near]
    between = among @ among.transpose(0, 2, 1)
    real = near >= 0
    chosen = np.zeros(near.shape, bool)
    for c in range(near.shape[1]):
        beaten = ((between[:, c, :] >= closeness[:, c, None]) & chosen).any(axis=1)
        chosen[:, c] = real[:, c] & ~beaten & (chosen.sum(axis=1) < most)
    spare = most // 2 - chosen.sum(axis=1)
    rest = real & ~chosen
    return chosen | (rest & (np.cumsum(rest, axis=1) <= spare[:, None]))


def _nearest_first(closeness: np.ndarray, count: int) -> np.ndarray:
    count = min(count, closeness.shape[1])
    some = np.argpartition(-closeness, count - 1, axis=1)[:, :count]
    order = np.argsort(-np.take_along_axis(closeness, some, axis=1), axis=1, kind="stable")
    return np.take_along_axis(some, order, axis=1)


def _chosen_edges(units: np.ndarray, links: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, neighbour) of the edges the nodes choose as they enter."""
    n, begin, found = len(units), 0, []
    while begin < n:
        end = min(max(2 * begin, 1), n)
        for start in range(begin, end, _STEP):
            nodes = np.arange(start, min(start + _STEP, end))
            closeness = units[nodes] @ units[:end].T
            closeness[np.arange(len(nodes)), nodes] = -np.inf
            near = _nearest_first(closeness, 3 * links)
            value = np.take_along_axis(closeness, near, axis=1)
            near = np.where(np.isinf(value), -1, near)
            rows, columns = np.nonzero(_spread(units, near, value, links))
            found.append(np.stack([nodes[rows], near[rows, columns]]))
        begin = end
    edges = np.concatenate(found, axis=1) if found else np.empty((2, 0), int)
    return edges[0], edges[1]


def _reached(neighbours: list[np.ndarray], entries: list[int]) -> np.ndarray:
    seen = np.zeros(len(neighbours), bool)
    front = np.array(entries, int)
    while len(front):
        seen[front] = True
        front = np.unique(np.concatenate([neighbours[i] for i in front.tolist()]))
        front = front[~seen[front]]
    return seen


def build(vectors: np.ndarray, links: int = LINKS) -> tuple[list[np.ndarray], list[int]]:
    """Neighbours of every node, and the entries."""
    units, n = _units(vectors), len(vectors)
    a, b = _chosen_edges(units, links)
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = both // n, both % n
    neighbours = np.split(b, np.searchsorted(a, np.arange(1, n)))
    for i, own in enumerate(neighbours):
        if len(own) > 2 * links:  # of too many the nearest, and among them the well spread ones
            closeness = units[own] @ units[i]
            order = np.argsort(-closeness, kind="stable")[: 4 * links]
            kept = _spread(units, own[order][None], closeness[order][None], 2 * links)[0]
            neighbours[i] = own[order][kept]
    entries = list(range(min(_ENTRIES, n)))
    while not (seen := _reached(neighbours, entries)).all():
        entries.append(int(np.flatnonzero(~seen)[0]))
    return neighbours, entries


def _padded(neighbours: list[np.ndarray]) -> np.ndarray:
    width = max((len(x) for x in neighbours), default=1) or 1
    table = np.full((len(neighbours), width), -1, np.int64)
    for i, own in enumerate(neighbours):
        table[i, : len(own)] = own
    return table


def walk(units: np.ndarray, table: np.ndarray, entries: np.ndarray, targets: np.ndarray, effort: int) -> tuple[np.ndarray, int]:
    """The nodes kept for each target (row; -1 for none), and how many distances were computed."""
    queries, n = len(targets), len(units)
    seen = np.zeros((queries, n), bool)
    seen[:, entries] = True
    first = targets @ units[entries].T
    order = _nearest_first(first, effort)
    nodes = np.full((queries, effort), -1)
    value = np.full((queries, effort), -np.inf, np.float32)
    nodes[:, : order.shape[1]], value[:, : order.shape[1]] = entries[order], np.take_along_axis(first, order, axis=1)
    open_ = nodes >= 0
    live, computed = np.arange(queries), first.size
    while len(live):
        # follow the best open nodes of each walker
        ahead = np.where(open_[live], value[live], -np.inf)
        place = _nearest_first(ahead, _FOLLOWED)
        going = np.isfinite(np.take_along_axis(ahead, place, axis=1))
        live, place, going = live[going[:, 0]], place[going[:, 0]], going[going[:, 0]]
        if not len(live):
            break
        at = np.where(going, nodes[live[:, None], place], 0)
        open_[live[:, None], place] = False
        found = np.where(going[:, :, None], table[at], -1).reshape(len(live), -1)
        fresh = (found >= 0) & ~seen[live[:, None], found]
        rows, columns = np.nonzero(fresh)
        # a node found twice in one step counts once
        keys, once = np.unique(rows * n + found[rows, columns], return_index=True)
        rows, columns, found_nodes = rows[once], columns[once], keys % n
        seen[live[rows], found_nodes] = True
        computed += len(rows)
        closeness = np.einsum("ij,ij->i", units[found_nodes], targets[live[rows]])
        more = np.full(found.shape, -np.inf, np.float32)
        more[rows, columns] = closeness
        both = np.concatenate([value[live], more], axis=1)
        names = np.concatenate([nodes[live], found], axis=1)
        state = np.concatenate([open_[live], np.isfinite(more)], axis=1)
        best = _nearest_first(both, effort)
        value[live] = np.take_along_axis(both, best, axis=1)
        nodes[live] = np.where(np.isfinite(value[live]), np.take_along_axis(names, best, axis=1), -1)
        open_[live] = np.take_along_axis(state, best, axis=1) & np.isfinite(value[live])
    return nodes, computed


@dataclass(frozen=True)
class Graph:
    shards: DataFrame
    dim: int


def write_graph(embeddings: DataFrame, dim: int, path: str, links: int = LINKS, shard_rows: int = SHARD_ROWS) -> None:
    """Builds each shard in a task of its own and writes it as one row."""
    shards = max(1, -(-embeddings.count() // shard_rows))

    def grown(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place").combine_chunks()
        flat = rows["embedding"].combine_chunks()
        neighbours, entries = build(matrix(flat, dim), links)
        lists = [rows["article_id"].to_pylist(), flat.flatten(), [len(x) for x in neighbours], np.concatenate(neighbours), entries]
        kinds = [pa.string(), pa.float32(), pa.int32(), pa.int32(), pa.int32()]
        columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in zip(lists, kinds)]
        names = ["article_ids", "vectors", "sizes", "links", "entries"]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), *columns], ["shard", *names])

    # the hash that picks the shard is not the one that orders it
    filed = embeddings.select(
        "article_id", "embedding",
        F.pmod(F.xxhash64("article_id"), F.lit(shards)).cast("int").alias("shard"),
        F.sha2("article_id", 256).alias("place"),
    )
    filed.groupBy("shard").applyInArrow(grown, _SHARD).write.parquet(path)


def open_graph(spark: SparkSession, path: str, dim: int) -> Graph:
    return Graph(spark.read.schema(_SHARD).parquet(path), dim)


def edges(graph: Graph) -> DataFrame:
    """The edges as (article_id, neighbour_id)."""
    links = graph.shards.select("article_ids", "links", F.posexplode("sizes").alias("node", "size"), "sizes")
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("node")), F.lit(0), lambda total, x: total + x)
    own = links.select("article_ids", F.get("article_ids", "node").alias("article_id"), F.explode(F.slice("links", before + 1, F.col("size"))).alias("to"))
    return own.select("article_id", F.get("article_ids", "to").alias("neighbour_id"))


def _walked(graph: Graph, queries: pa.Table, effort: int) -> DataFrame:
    """The k best of each query and task."""
    dim = graph.dim
    names, limits = queries.column("query_id").to_pylist(), queries.column("k").to_pylist()
    targets = matrix(queries.column("embedding").combine_chunks(), dim)
    shipped = graph.shards.sparkSession.sparkContext.broadcast((names, limits, targets))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, limits, targets = shipped.value
        best, heading = Best(limits), _units(targets)
        kept = max(effort, max(limits, default=0))
        for batch in batches:
            for row in range(batch.num_rows):
                ids, flat, sizes, links, entries = (batch[c][row].values for c in ("article_ids", "vectors", "sizes", "links", "entries"))
                vectors = np.asarray(flat).astype(np.float64).reshape(-1, dim)
                units, ids = _units(vectors), np.array(ids.to_pylist(), dtype=object)
                table = _padded(np.split(np.asarray(links), np.cumsum(np.asarray(sizes))[:-1]))
                for start in range(0, len(targets), _WALKERS):
                    among = np.arange(start, min(start + _WALKERS, len(targets)))
                    nodes, _ = walk(units, table, np.asarray(entries), heading[among], kept)
                    asked, own, value = [], [], []
                    for query, near in zip(among, nodes):
                        near = near[near >= 0]
                        exact = distances(vectors[near], targets[query : query + 1])[:, 0]
                        exact = np.where(np.isnan(exact), np.inf, exact)
                        good = exact <= best.worst[query]
                        asked.append(np.full(good.sum(), query))
                        own.append(near[good])
                        value.append(exact[good])
                    used, place = np.unique(np.concatenate(own), return_inverse=True)
                    best.merge(np.concatenate(asked), np.concatenate(value), ids[used], place)
        yield pa.RecordBatch.from_pydict(best.batch(names), schema=HITS)

    return graph.shards.select("article_ids", "vectors", "sizes", "links", "entries").mapInArrow(scan, HITS_DDL)


def search_graph(graph: Graph, queries: DataFrame, effort: int = EFFORT, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(query_id, rank, article_id, similarity_score) for a table of (query_id, embedding, requested)."""
    asked = asked_of(queries)
    return ranked(met(asked, graph.dim, block_values, lambda block: _walked(graph, block, effort)))
