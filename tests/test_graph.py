import numpy as np
import pytest

from feedloom.operators import ann, graph, search
from tests.tables import at, fid, vectors
from tests.test_search import brute

DIM = 16
QUERIES = "query_id int, embedding array<float>, requested int"


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(11).normal(size=(5000, DIM)).astype(np.float32)


@pytest.fixture(scope="module")
def stored(spark, noise):
    return vectors(spark, *[(i, v.tolist(), at()) for i, v in enumerate(noise)]).repartition(6).cache()


@pytest.fixture(scope="module")
def written(spark, stored, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("graphs") / "graph")
    graph.write_graph(stored, DIM, path, shard_rows=1500)
    return graph.open_graph(spark, path, DIM)


def asked(spark, noise, numbers, k=10):
    return spark.createDataFrame([(i, noise[i].tolist(), k) for i in numbers], QUERIES)


def hits(frame):
    found = {}
    for r in frame.orderBy("query_id", "rank").collect():
        found.setdefault(int(r.query_id), []).append((r["rank"], r.article_id))
    assert all([rank for rank, _ in own] == list(range(1, len(own) + 1)) for own in found.values())
    return {q: [a for _, a in own] for q, own in found.items()}


def test_recall_over_shards(spark, written, noise):
    numbers = range(0, 5000, 50)
    got = hits(graph.search_graph(written, asked(spark, noise, numbers), effort=64))
    right = sum(len(set(got[q]) & set(brute(noise, noise[q], 10))) for q in numbers)
    assert right >= 0.95 * 1000
    assert all(len(own) == 10 and own[0] == fid(q) for q, own in got.items())


def test_more_effort_finds_all(spark, written, noise):
    got = hits(graph.search_graph(written, asked(spark, noise, (3, 77), 50), effort=1500))
    assert all(got[q] == brute(noise, noise[q], 50) for q in (3, 77))


def test_queries_in_blocks(spark, written, noise):
    numbers = range(0, 300, 10)
    whole = hits(graph.search_graph(written, asked(spark, noise, numbers)))
    assert hits(graph.search_graph(written, asked(spark, noise, numbers), block_values=DIM * 4)) == whole
    assert graph.search_graph(written, asked(spark, noise, [0]).limit(0)).count() == 0


def test_a_walk_computes_few_distances(noise):
    big = np.random.default_rng(5).normal(size=(8000, DIM))
    neighbours, entries = graph.build(big)
    units = graph._units(big)
    nodes, computed = graph.walk(units, graph._padded(neighbours), np.array(entries), units[:200], 32)
    exact = np.argsort(-(units[:200] @ units.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(exact.tolist(), nodes.tolist())]) > 0.95
    assert computed < 0.12 * 200 * 8000


def test_every_node_is_reached_and_edges_are_bounded():
    rng = np.random.default_rng(6)
    clumps = np.repeat(rng.normal(size=(6, DIM)), 150, axis=0)  # groups of equal vectors
    for data in (clumps, np.concatenate([clumps, np.zeros((40, DIM))]), rng.normal(size=(1, DIM)), rng.normal(size=(2, DIM))):
        neighbours, entries = graph.build(data, links=4)
        assert graph._reached(neighbours, entries).all()
        assert max(len(x) for x in neighbours) <= 8 and all(i not in x for i, x in enumerate(neighbours))


def test_stored_edges(spark, written):
    table = graph.edges(written)
    degree = table.groupBy("article_id").count().agg({"count": "max"}).first()[0]
    assert degree <= 2 * graph.LINKS
    assert table.select("article_id").distinct().count() == 5000
    assert table.where("article_id = neighbour_id").count() == 0


def test_zero_vectors_come_last_and_none_is_found_in_none(spark, tmp_path):
    rows = vectors(spark, (1, [0.0] * DIM, at()), (2, [1.0] * DIM, at()), (3, [-1.0] * DIM, at()))
    graph.write_graph(rows, DIM, str(tmp_path / "few"))
    ask = spark.createDataFrame([(0, [1.0] * DIM, 5)], QUERIES)
    assert hits(graph.search_graph(graph.open_graph(spark, str(tmp_path / "few"), DIM), ask)) == {0: [fid(2), fid(3), fid(1)]}
    graph.write_graph(rows.limit(0), DIM, str(tmp_path / "none"))
    assert graph.search_graph(graph.open_graph(spark, str(tmp_path / "none"), DIM), ask).count() == 0


SHORT = 8


@pytest.fixture(scope="module")
def short(noise):
    return np.ascontiguousarray(noise[:, :SHORT])


@pytest.fixture(scope="module")
def index(spark, short, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("buckets") / "index")
    ann.write_index(vectors(spark, *[(i, v.tolist(), at()) for i, v in enumerate(short)]), SHORT, path)
    return ann.open_index(spark, path)


def recall(got, data):
    return np.mean([len(set(own) & set(brute(data, data[q], 10))) / 10 for q, own in got.items()])


def test_batch_over_buckets_as_one_search_each(spark, index, short):
    numbers = range(0, 5000, 500)
    got = hits(ann.search_index_batch(index, asked(spark, short, numbers), SHORT))
    for q in numbers:
        assert got[q] == [r.article_id for r in ann.search_index(index, short[q].tolist(), 10).collect()]
    blocks = ann.search_index_batch(index, asked(spark, short, numbers), SHORT, block_values=SHORT * 3)
    assert hits(blocks) == got


def test_batch_recall(spark, index, short):
    ask = asked(spark, short, range(0, 5000, 50))
    assert recall(hits(ann.search_index_batch(index, ask, SHORT)), short) >= 0.95  # probes 24 % of the vectors
    assert recall(hits(ann.search_index_batch(index, ask, SHORT, wanted=2500)), short) >= 0.99
    all_ = hits(ann.search_index_batch(index, asked(spark, short, (1, 2), 50), SHORT, wanted=5000))
    assert all_ == {q: brute(short, short[q], 50) for q in (1, 2)}


def test_batch_reads_only_probed_buckets(spark, index, short):
    ask = asked(spark, short, (5,))
    block = ann.probes(index, search.asked_of(ask), SHORT, wanted=100)
    probed = block.first().buckets
    assert 0 < len(probed) < len(index.sizes)
    plan = ann._within_buckets(index.vectors, block.toArrow(), SHORT)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and str(probed[0]) in plan
    assert ann.search_index_batch(index, ask.limit(0), SHORT).count() == 0
