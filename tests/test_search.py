import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.functions.vectors import distances as search_distances
from feedloom.operators import ann, enrich, search
from tests.tables import articles, at, fid, vectors

DIM = 8


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    return rng.normal(size=(300, DIM)).astype(np.float32)


@pytest.fixture(scope="module")
def stored(spark, data):
    return vectors(spark, *[(i, v.tolist(), at()) for i, v in enumerate(data)]).repartition(7).cache()


def brute(data, query, k, ids=None):
    a, q = data.astype(np.float64), np.asarray(query, dtype=np.float64)
    d = 1 - (a @ q) / (np.linalg.norm(a, axis=1) * np.linalg.norm(q))
    rows = sorted((round(x, 12), fid(i)) for i, x in enumerate(d) if ids is None or i in ids)
    return [i for _, i in rows[:k]]


def test_nearest(stored, data):
    for q in (0, 17):
        got = search.nearest(stored, data[q].tolist(), 9).collect()
        assert [r.article_id for r in got] == brute(data, data[q], 9)
        assert got[0].distance == pytest.approx(0, abs=1e-9)


def test_search_joins_articles_and_limits(spark, stored, data):
    table = articles(spark, *[(i, 1, f"u{i}", 5, at()) for i in range(0, 120)])
    hits = search.search(table, stored, data[3].tolist(), "7").collect()
    assert [r.id for r in hits] == brute(data, data[3], 7, range(120))
    assert hits[0].similarity_score == pytest.approx(1) and hits[0].raw_content == "raw"
    assert search.search(table, stored, data[3].tolist()).count() == 5
    assert search.search(table, stored, data[3].tolist(), 1000).count() == 50
    assert search.search(table.limit(0), stored, data[3].tolist(), 3).collect() == []


def test_search_among_many_orphans(spark, stored, data):
    far = brute(data, data[3], 300)[-6:]
    table = articles(spark, *[(int(i[-3:]), 1, f"u{i}", 5, at()) for i in far])
    assert [r.id for r in search.search(table, stored, data[3].tolist(), 5).collect()] == far[:5]
    assert [r.id for r in search.search(table, stored, data[3].tolist(), 50).collect()] == far


def test_ties_zero_vectors_and_wrong_lengths(spark):
    rows = vectors(spark, (4, [1, 0], at()), (2, [2, 0], at()), (3, [0, 0], at()), (1, [-1, 0], at()), (0, [0, 1], at()))
    got = [(r.article_id, r.distance) for r in search.nearest(rows, [1.0, 0.0], 5).collect()]
    assert [g[0] for g in got] == [fid(2), fid(4), fid(0), fid(1), fid(3)]
    assert [g[1] for g in got[:4]] == [0, 0, 1, 2] and math.isnan(got[4][1])
    with pytest.raises(Exception, match="dimensions"):
        search.nearest(rows.unionByName(vectors(spark, (9, [1], at()))), [1.0, 0.0], 5).collect()


def batches(spark, stored, asked, **kw):
    rows = spark.createDataFrame(asked, "query_id int, embedding array<float>, requested int")
    found = search.batch_search(stored, rows, DIM, **kw).orderBy("query_id", "rank").collect()
    out = {}
    for r in found:
        out.setdefault(int(r.query_id), []).append(r.article_id)
    return out


@pytest.mark.parametrize("block_values", [search.BLOCK_VALUES, DIM * 3])
def test_batch_is_exact_by_both_ways(spark, stored, data, block_values):
    limits = {0: -2, 1: 0, 2: 3, 3: 7, 4: 50, 5: 60, 6: None, 7: 1}
    asked = [(q, data[q * 11].tolist(), k) for q, k in limits.items()]
    got = batches(spark, stored, asked, block_values=block_values)
    for q, k in limits.items():
        assert got[q] == brute(data, data[q * 11], min(50, k) if k and k > 0 else 5), q


@pytest.mark.parametrize("block_values", [search.BLOCK_VALUES, 2])
def test_batch_keeps_ties_until_the_ids_decide(spark, block_values):
    # many copies of one vector: more ties than any limit
    rows = vectors(spark, *[(i, [1.0] * DIM, at()) for i in range(400)], (999, [0.0] * DIM, at())).repartition(5)
    asked = [(0, [1.0] * DIM, 50), (1, [2.0] * DIM, 2)]
    got = batches(spark, rows, asked, block_values=block_values * DIM)
    assert got == {0: [fid(i) for i in range(50)], 1: [fid(0), fid(1)]}


def test_blocks_of_distances_are_bounded(monkeypatch, data):
    monkeypatch.setattr(search, "_CELLS", 40)
    best, seen = search.Best([3, 1, 50]), []
    monkeypatch.setattr(search, "distances", lambda rows, asked: seen.append(len(rows) * len(asked)) or search_distances(rows, asked))
    ids = pa.array([fid(i) for i in range(len(data))])
    search.feed(best, ids, pa.array(data.tolist(), pa.list_(pa.float32())), data[:3].astype(np.float64))
    found = best.batch(["a", "b", "c"])
    assert max(seen) <= 40
    for q, k in (("a", 3), ("b", 1), ("c", 50)):
        assert [i for i, name in zip(found["article_id"], found["query_id"]) if name == q] == brute(data, data["abc".index(q)], k)


def test_candidates_of_one_query_leave_the_others_alone(monkeypatch):
    """What a block sorts grows with its own candidates, not with all that is kept."""
    rng = np.random.default_rng(3)
    found = rng.integers(0, 40, (600, 300)) / 16.0  # ties everywhere
    found[5, 7] = np.nan
    ids = np.array([f"{i:04d}" for i in rng.permutation(600)], object)
    best, sorted_ = search.Best([10] * 300), []
    best.add(ids[:400], found[:400])
    plain = np.lexsort
    monkeypatch.setattr(search.np, "lexsort", lambda keys: sorted_.append(len(keys[0])) or plain(keys))
    for query in range(300):
        best.add(ids[400:], found[400:, [query]], np.array([query]))
    assert max(sorted_) < 400
    got = best.batch(range(300))
    for query in range(300):
        order = plain((ids, np.where(np.isnan(found[:, query]), np.inf, found[:, query])))[:10]
        assert [i for i, q in zip(got["article_id"], got["query_id"]) if q == query] == ids[order].tolist()


def test_many_queries_get_the_vectors_dealt_out(spark, stored, data, monkeypatch):
    rows = stored.coalesce(1)
    plan = lambda: search._with_shipped_queries(rows.select("article_id", "embedding"), asked, DIM)._jdf.queryExecution().toString()
    asked = pa.table({"query_id": ["a", "b"], "embedding": pa.array(data[:2].tolist(), pa.list_(pa.float32())), "k": [1, 1]})
    assert "hashpartitioning" not in plan()
    monkeypatch.setattr(search, "_MANY", 2)
    assert "hashpartitioning(article_id" in plan()
    got = batches(spark, rows, [(0, data[0].tolist(), 5), (1, data[1].tolist(), 5)])
    assert got == {q: brute(data, data[q], 5) for q in (0, 1)}


def test_batch_with_few_vectors_ranks_zero_vectors_last(spark):
    rows = vectors(spark, (1, [0.0] * DIM, at()), (2, [1.0] * DIM, at()))
    assert batches(spark, rows, [(0, [1.0] * DIM, 5)]) == {0: [fid(2), fid(1)]}
    assert batches(spark, rows, []) == {}


def test_batch_of_known_articles(spark, stored, data):
    table = articles(spark, *[(i, 1, f"u{i}", 5, at()) for i in range(0, 50)])
    got = batches(spark, stored, [(0, data[60].tolist(), 4)], articles=table)
    assert got[0] == brute(data, data[60], 4, range(50))


def test_approximate_search_recall(spark, stored, data, tmp_path):
    shares = []
    for size in (300, 6000):
        path, rows = str(tmp_path / f"index{size}"), np.random.default_rng(size).normal(size=(size, DIM)).astype(np.float32)
        ann.write_index(vectors(spark, *[(i, v.tolist(), at()) for i, v in enumerate(rows)]), DIM, path)
        index = ann.open_index(spark, path)
        assert index.rows == size
        hits, read = 0, 0
        for q in range(0, size, size // 10):
            got = ann.search_index(index, rows[q].tolist(), 10).collect()
            assert len(got) == 10
            hits += len({r.article_id for r in got} & set(brute(rows, rows[q], 10)))
            read += sum(index.sizes[b] for b in ann.buckets_to_probe(index, rows[q], ann.candidates_for(size, 10)))
        assert hits >= 90  # of 100
        shares.append(read / size / 10)
    assert shares[1] < 0.6 * shares[0]
    exact = ann.search_index(index, rows[5].tolist(), 10, wanted=size).collect()
    assert [r.article_id for r in exact] == brute(rows, rows[5], 10)


def test_buckets_are_taken_until_they_hold_enough(spark, stored, data, tmp_path):
    path = str(tmp_path / "index")
    ann.write_index(stored, DIM, path)
    index = ann.open_index(spark, path)
    assert len(ann.search_index(index, data[5].tolist(), 200, wanted=1).collect()) == 200
    few = ann.buckets_to_probe(index, data[5], 20)
    assert sum(index.sizes[b] for b in few) >= 20 > sum(index.sizes[b] for b in few[:-1])


def test_probed_buckets_prune_the_scan(spark, stored, data, tmp_path):
    path = str(tmp_path / "index")
    ann.write_index(stored, DIM, path)
    probed = ann.search_index(ann.open_index(spark, path), data[0].tolist(), 3)
    plan = probed._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "TakeOrderedAndProject" in plan


def test_search_by_text_and_response(spark):
    provider = enrich.OfflineProvider()
    table = articles(spark, (1, 1, "u1", 5, at()), (2, 1, "u2", 5, at())).withColumn(
        "raw_content", F.when(F.col("url") == "u2", "").otherwise(F.col("raw_content"))
    )
    vectors_of, _ = enrich.embed_articles(table, provider, F.current_timestamp())
    hits = search.search_text(table, vectors_of, provider, " words ", 5)
    row = search.response(hits, "words").first()
    documents = [json.loads(d) for d in row.results]
    assert (row.query, row["count"], len(documents)) == ("words", 2, 2)
    assert documents[0]["article"]["id"] == fid(1) and documents[0]["article"]["raw_content"] == "raw"
    assert documents[0]["article"]["published_at"] is None
    assert documents[0]["article"]["created_at"] == "2024-01-02T00:00:00Z"
    assert "raw_content" not in documents[1]["article"]
    assert documents[0]["similarity_score"] == pytest.approx(1)
    with pytest.raises(ValueError):
        search.search_text(table, vectors_of, provider, "   ")


def test_blank_queries_are_split_off(spark):
    rows = spark.createDataFrame([("a",), (" ",)], "query string")
    good, bad = search.split_queries(rows)
    assert [r.query for r in good.collect()] == ["a"] and [r.reason for r in bad.collect()] == ["empty_query"]
