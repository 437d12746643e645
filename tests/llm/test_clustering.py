import hashlib
import math

import numpy as np
import pytest

from feedloom.llm import clustering

VECTORS = "vec_id long, embedding array<float>, label int, cluster string, x int, row string"


def table(spark, vectors):
    rows = [(i, v, 0, "c", 1, "r") for i, v in vectors]
    return spark.createDataFrame(rows, VECTORS)


def brute(vectors, count=40, rounds=5):
    points = []
    for i, v in vectors:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * float(np.float32(x))) for x in v]
            points.append((i, whole))
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), p) for i, p in points)[:count]
    centroids = np.array([p for _, p in first], np.int64)
    matrix = np.array([p for _, p in points], np.int64)

    def assign():
        far = ((matrix[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        return far.argmin(axis=1), far.min(axis=1)

    for _ in range(rounds):
        cluster, _ = assign()
        for k in range(len(centroids)):
            own = matrix[cluster == k]
            if len(own):
                centroids[k] = own.sum(axis=0) // len(own)
    cluster, far = assign()
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return sorted(
        ((i, int(k), int(d), int(far[cluster == k].sum()), int(far.sum()), names[k]) for (i, _), k, d in zip(points, cluster, far)), key=repr
    )


def found_in(frame):
    assert frame.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def grouped(seed, n, groups=12, noise=0.02):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.3, (groups, 64))
    return [(i, (middles[i % groups] + rng.normal(0, noise, 64)).astype(np.float32).tolist()) for i in range(n)]


def test_equals_brute_force(spark):
    vectors = grouped(1, 900, noise=0.2)
    assert found_in(clustering.report(table(spark, vectors).repartition(4))) == brute(vectors)


def test_unfit_vectors_repeats_and_nulls(spark):
    vectors = grouped(2, 60)
    bad = [(900, None), (901, []), (902, [0.1] * 63), (903, [0.1] * 65), (904, [None] + [0.1] * 63), (905, [float("nan")] + [0.1] * 63), (906, [0.1] * 63 + [float("-inf")])]
    some = vectors + [(3, vectors[3][1]), (3, vectors[4][1]), (None, vectors[5][1]), (None, vectors[5][1])] + [(700 + i, [0.5] * 64) for i in range(40)]
    assert found_in(clustering.report(table(spark, some + bad))) == brute(some + bad)


def test_few_and_no_vectors(spark):
    vectors = grouped(3, 7)
    assert found_in(clustering.report(table(spark, vectors))) == brute(vectors)
    none = clustering.report(table(spark, [(1, None), (2, [0.5])]))
    assert found_in(none) == [] and none.schema == clustering.report(table(spark, vectors)).schema
    assert clustering.report(table(spark, vectors).limit(0)).count() == 0


def test_equal_vectors_are_spread_over_blocks(spark):
    vectors = [(1, [0.25] * 64)] * 700 + grouped(4, 100)
    rows = clustering.blocks(clustering.kept(table(spark, vectors)), size=32).collect()
    assert sum(len(r.ids) for r in rows) == 800 and max(len(r.ids) for r in rows) == 32
    assert found_in(clustering.report(table(spark, vectors))) == brute(vectors)


def test_the_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    place = clustering.hilbert(grid, 3)
    assert sorted(place.tolist()) == list(range(512))
    path = grid[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_boxes_leave_out_only_what_cannot_win(spark):
    vectors = grouped(5, 1200)
    rows = clustering.blocks(clustering.kept(table(spark, vectors)), size=16).collect()
    centroids = np.floor(256 * np.array([v for _, v in vectors[:24]])).astype(np.int64)
    low, high = (np.array([np.frombuffer(r[c], "<i4") for r in rows], np.int64) for c in ("low", "high"))
    chosen = clustering.candidates(low, high, centroids)
    for r, among, lo, hi in zip(rows, chosen, low, high):
        points = np.frombuffer(r.points, "<i4").reshape(-1, 64).astype(np.int64)
        assert (points.min(axis=0) == lo).all() and (points.max(axis=0) == hi).all()
        far = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        best, distance = clustering.nearest(points, centroids, np.flatnonzero(among))
        assert (best == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
    # 12 separate groups of two centroids each: most blocks need only those of their own groups
    assert chosen.mean() < 0.35


def test_large_components(spark):
    vectors = [(i, [(-1.0) ** j * (4000.5 + 1000 * i) for j in range(64)]) for i in range(50)] + [(99, [500000.0] * 64)]
    assert found_in(clustering.report(table(spark, vectors))) == brute(vectors)
    with pytest.raises(Exception, match="too large"):
        clustering.report(table(spark, [(1, [1e30] * 64)])).collect()
