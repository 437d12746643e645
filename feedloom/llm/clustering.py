"""Centroid clustering over zone maps along a space-filling curve.

Vectors become integers, are ordered along a Hilbert curve through the directions in which they vary
most, and are cut into blocks. A block is one row: its vectors, and the smallest and largest value
of each component (its box). In every round the box decides which centroids a block needs: with the
centroid nearest to the box's middle as pivot, a centroid whose squared distance exceeds the pivot's
at every point of the box cannot win and is left out. The greatest lead that it could have is a sum over components, each
taken at the box's better end, so the test is exact. The vectors are then compared with the candidates
only, as matrices, in exact integers.

Only centroids and one sum per cluster and component pass through the driver. Blocks are written once and read
in each round; equal vectors are spread over blocks by their row number.

Kept are vectors with exactly ``DIMENSIONS`` components, none null or non-finite; a null vector is not. A
component of ``2**19`` or more in size raises an error, as squared distances would not fit 64 bits.
Repeated ids are vectors of their own; a null id counts as empty text where ids are hashed. Equal hashes are ordered
by vector. With fewer vectors than centroids each vector is one; none kept: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import staged

DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SALT = "2:"
#: Vectors in a block, and the directions and bits of the curve.
BLOCK = 64
DIRECTIONS = 6
BITS = 8
_LARGEST = float(1 << 19)


def kept(table: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``vec_id``, ``x`` (integer components) and ``row``, written once."""
    values = table["embedding"]
    finite = F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = table.filter(F.coalesce((F.size(values) == dimensions) & finite, F.lit(False)))

    def whole(v):
        fits = F.abs(v) < _LARGEST
        return F.when(fits, F.floor(SCALE * v.cast("double")).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))

    return staged(rows.select("vec_id", F.transform(values, whole).alias("x"), F.monotonically_increasing_id().alias("row")), "vectors")


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, salt: str = SALT) -> np.ndarray:
    name = F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name, 256).alias("hash"), "x").orderBy("hash", "x").limit(count).collect()
    return np.array([r["x"] for r in rows], np.int64)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def directions(vectors: DataFrame, dimensions: int = DIMENSIONS, count: int = DIRECTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the directions of largest variance, and the standard deviations along them, over all vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dimensions + dimensions**2)
        for batch in batches:
            x = _matrix(batch["x"], dimensions).astype(float)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["place", "value"])

    sums = vectors.select("x").mapInArrow(moments, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    flat = np.zeros(1 + dimensions + dimensions**2)
    for r in sums.collect():
        flat[r["place"]] = r["value"]
    n, mean = max(flat[0], 1), flat[1 : 1 + dimensions] / max(flat[0], 1)
    spread = flat[1 + dimensions :].reshape(dimensions, dimensions) / n - np.outer(mean, mean)
    variance, axes = np.linalg.eigh((spread + spread.T) / 2)
    most = np.argsort(-variance)[: min(count, dimensions)]
    return mean, axes[:, most], np.sqrt(np.maximum(variance[most], 1e-12))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells, which lie in ``[0, 2**bits)``.

    From the finest bit to the coarsest a cell is turned into the frame of its quadrant, then the axes are
    Gray-decoded; the bits of all axes in turn, coarsest first, are the place.
    """
    x = cells.T.astype(np.int64).copy()
    axes = len(x)
    for bit in range(bits - 1, 0, -1):
        below = (1 << bit) - 1
        for i in range(axes):
            inside = (x[i] >> bit) & 1 == 1
            swapped = np.where(inside, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(inside, x[0] ^ below, x[0]) ^ swapped
            x[i] ^= swapped
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turned = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turned = np.where((x[axes - 1] >> bit) & 1 == 1, turned ^ ((1 << bit) - 1), turned)
    x ^= turned
    place = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            place = (place << 1) | ((x[i] >> bit) & 1)
    return place


def blocks(vectors: DataFrame, dimensions: int = DIMENSIONS, size: int = BLOCK) -> DataFrame:
    """Zone-mapped blocks: ``ids``, ``points`` (32-bit integers), ``low`` and ``high``, written once."""
    mean, axes, deviation = directions(vectors, dimensions)
    cells = 1 << BITS
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            along = (_matrix(batch["x"], dimensions) - mean) @ axes / deviation
            # three deviations to each side; what lies beyond is in the outer cells
            cell = np.clip((along + 3) / 6 * cells, 0, cells - 1).astype(np.int64)
            place = pa.array(hilbert(cell, BITS))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["x"], batch["row"], place], ["vec_id", "x", "row", "place"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch["x"], dimensions).astype("<i4")
            starts = np.arange(0, len(points), size)
            ends = np.minimum(starts + size, len(points))
            ids = pa.ListArray.from_arrays(pa.array(np.append(starts, len(points)), pa.int32()), batch["vec_id"])
            parts = [points[a:b] for a, b in zip(starts, ends)]
            columns = [[p.tobytes() for p in parts], [p.min(axis=0).tobytes() for p in parts], [p.max(axis=0).tobytes() for p in parts]]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.binary()) for c in columns)], ["ids", "points", "low", "high"])

    placed = staged(vectors.mapInArrow(keyed, f"vec_id {id_type}, x array<int>, row long, place long"), "placed")
    ordered = placed.repartitionByRange("place", "row").sortWithinPartitions("place", "row")
    return staged(ordered.select("vec_id", "x").mapInArrow(cut, f"ids array<{id_type}>, points binary, low binary, high binary"), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids (columns) may be nearest to some point of each box (rows)."""
    middle = (low + high)[:, None, :] - 2 * centroids[None]
    pivot = centroids[(middle.astype(float) ** 2).sum(axis=2).argmin(axis=1)]
    step = centroids[None] - pivot[:, None, :]
    # |x-c|^2 - |x-p|^2 = |c|^2 - |p|^2 - 2 x(c-p), least where x(c-p) is greatest
    reach = np.maximum(low[:, None, :] * step, high[:, None, :] * step).sum(axis=2)
    squares = (centroids**2).sum(axis=1)[None] - (pivot**2).sum(axis=1)[:, None]
    return squares - 2 * reach <= 0


def nearest(points: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centroids in ``among`` (ascending) and the squared distance, exact; ties: the first."""
    some = centroids[among]
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(some).max(initial=0)))
    if 4 * points.shape[1] * most**2 < 1 << 53:  # float products of such integers are exact
        cross = (points.astype(float) @ some.T.astype(float)).astype(np.int64)
    else:
        cross = points @ some.T
    score = (some**2).sum(axis=1)[None] - 2 * cross
    best = score.argmin(axis=1)
    return among[best], score[np.arange(len(points)), best] + (points**2).sum(axis=1)


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of a batch its number, points, clusters and distances."""
    width = centroids.shape[1]
    low, high = (np.frombuffer(b"".join(batch[c].to_pylist()), "<i4").reshape(-1, width).astype(np.int64) for c in ("low", "high"))
    for start in range(0, len(low), 256):
        chosen = candidates(low[start : start + 256], high[start : start + 256], centroids)
        for i, row in enumerate(chosen, start):
            points = np.frombuffer(batch["points"][i].as_py(), "<i4").reshape(-1, width).astype(np.int64)
            yield i, points, *nearest(points, centroids, np.flatnonzero(row))


def moved(found: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    count, width = centroids.shape
    names = [f"s{i}" for i in range(width)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(count, np.int64), np.zeros((count, width), np.int64)
        for batch in batches:
            for _, points, cluster, _ in _assigned(batch, centroids):
                n += np.bincount(cluster, minlength=count)
                np.add.at(total, cluster, points)
        some = np.flatnonzero(n)
        columns = [pa.array(some, pa.int32()), pa.array(n[some]), *(pa.array(total[some, i]) for i in range(width))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", *names])

    schema = "cluster int, n long, " + ", ".join(f"{s} long" for s in names)
    rows = found.select("points", "low", "high").mapInArrow(sums, schema).groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
    after = centroids.copy()
    for r in rows.collect():
        after[r["cluster"]] = [r[s] // r["n"] for s in names]
    return after


def assigned(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id``, ``cluster`` and ``distance`` of every vector."""
    id_type = found.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(c, d) for _, _, c, d in _assigned(batch, centroids)]
            if parts:
                cluster, distance = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([batch["ids"].flatten(), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return found.select("ids", "points", "low", "high").mapInArrow(run, f"vec_id {id_type}, cluster int, distance long")


def clustered(table: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """The assignment of every kept vector, and the centroids it refers to."""
    vectors = kept(table, dimensions)
    centroids = first_centroids(vectors, count)
    if not len(centroids):
        return vectors.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    found = blocks(vectors, dimensions)
    for _ in range(rounds):
        centroids = moved(found, centroids)
    return assigned(found, centroids), centroids


def report(table: DataFrame) -> DataFrame:
    rows, centroids = clustered(table)
    rows = staged(rows, "clusters")
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    figures = [(k, sums.get(k, 0), sum(sums.values()), name) for k, name in enumerate(names)]
    # one row per centroid
    few = rows.sparkSession.createDataFrame(figures, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
