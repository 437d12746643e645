import pathlib

import pytest
from pyspark.sql import functions as F

from feedloom.operators import keyed
from tests.tables import articles, at, feeds, fid, vectors

DIM = 4


def files(table):
    found = {}
    for file in pathlib.Path(table.path).glob("*=*/*.parquet"):
        found.setdefault(int(file.parent.name.split("=")[1]), set()).add((file.name, file.stat().st_mtime_ns))
    return found


@pytest.fixture
def stored(spark, tmp_path):
    frame = vectors(spark, *[(i, [i, 1, 2, 3], at()) for i in range(200)])
    return keyed.write_keyed(frame, "article_id", str(tmp_path / "vectors"), 32)


def values(spark, table):
    return {int(r.article_id[-3:]): r.embedding[0] for r in keyed.rows(spark, table).collect()}


def test_rows_come_back(spark, stored):
    assert values(spark, stored) == {i: float(i) for i in range(200)}
    assert keyed.rows(spark, stored).where(F.col(keyed.PART) != stored.part()).count() == 0


def test_an_upsert_leaves_other_partitions_alone(spark, stored):
    before = files(stored)
    updates = vectors(spark, (7, [70, 1, 2, 3], at(3)), (7, [71, 1, 2, 3], at(4)), (900, [9, 1, 2, 3], at()), (8, [1, 2], at()))
    rejected = keyed.upsert_vectors(spark, stored, updates, DIM)
    assert rejected.count() == 1
    want = {i: float(i) for i in range(200)} | {7: 71.0, 900: 9.0}
    assert values(spark, stored) == want
    after = files(stored)
    changed = {p for p in after if after[p] != before.get(p)}
    asked = spark.createDataFrame([(fid(7),), (fid(900),)], "article_id string")
    assert changed == set(keyed._parts(asked, stored)) and len(changed) <= 2
    keyed.upsert_vectors(spark, stored, updates, DIM)
    assert values(spark, stored) == want


def test_emptied_partitions(spark, stored):
    home = keyed.rows(spark, stored).groupBy(keyed.PART).count().orderBy("count", keyed.PART).first()[keyed.PART]
    doomed = keyed.rows(spark, stored).where(F.col(keyed.PART) == home).select("article_id")
    doomed = spark.createDataFrame(doomed.collect(), "article_id string")
    assert keyed.delete_keys(spark, stored, doomed) == [home]
    left = values(spark, stored)
    assert len(left) == 200 - doomed.count() and keyed.rows(spark, stored).where(F.col(keyed.PART) == home).count() == 0
    # and filled again
    keyed.upsert_vectors(spark, stored, doomed.select("article_id", F.lit([5.0, 1.0, 2.0, 3.0]).cast("array<float>").alias("embedding"), F.lit(at()).alias("created_at")), DIM)
    assert len(values(spark, stored)) == 200


def test_lookups_read_one_partition(spark, stored):
    found = keyed.find(spark, stored, fid(42))
    assert [r.embedding[0] for r in found.collect()] == [42.0] and found.columns == stored.schema.fieldNames()
    plan = found._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    assert "PartitionFilters: [isnotnull(key_part" in scan and "EqualTo(article_id" in scan
    assert keyed.find(spark, stored, "no id").count() == 0
    asked = spark.createDataFrame([(fid(3),), (fid(3),), (fid(199),), (fid(500),), (None,)], "article_id string")
    many = keyed.find_all(spark, stored, asked)
    assert sorted(r.embedding[0] for r in many.collect()) == [3.0, 199.0]
    assert "PartitionFilters: [" in next(line for line in many._jdf.queryExecution().toString().splitlines() if "FileScan parquet [article_id" in line and "key_part" in line)


def test_refusals(spark, stored, tmp_path):
    with pytest.raises(Exception, match="without article_id"):
        keyed.write_keyed(spark.createDataFrame([(None, 1)], "article_id string, x int"), "article_id", str(tmp_path / "x"))
    one = spark.createDataFrame([(fid(1),)], "article_id string")
    every = vectors(spark, *[(i, [0, 0, 0, 0], at()) for i in range(100)])
    with pytest.raises(ValueError, match="none of its keys"):
        keyed.change(spark, stored, one, lambda rows: every)
    assert keyed.change(spark, stored, one.limit(0), lambda rows: every) == []
    assert values(spark, stored) == {i: float(i) for i in range(200)}


def test_cascade(spark, tmp_path):
    owners = keyed.write_keyed(feeds(spark, (1, "https://a", "a", True), (2, "https://b", "b", True), (3, "https://c", "c", True)), "id", str(tmp_path / "f"), 8)
    texts = keyed.write_keyed(articles(spark, *[(i, 1 + i % 3, f"u{i}", 5, at()) for i in range(30)]), "id", str(tmp_path / "a"), 8)
    stored = keyed.write_keyed(vectors(spark, *[(i, [1, 1, 1, 1], at()) for i in range(0, 40)]), "article_id", str(tmp_path / "v"), 8)
    asked = spark.createDataFrame([(fid(2).upper(),), (fid(2),), (fid(9),), ("junk",)], "id string")
    for _ in range(2):  # repeated, it changes nothing
        unknown = {r.id for r in keyed.delete_feeds(spark, owners, texts, stored, asked).collect()}
        assert {int(r.id[-3:]) for r in keyed.rows(spark, owners).collect()} == {1, 3}
        assert {int(r.id[-3:]) for r in keyed.rows(spark, texts).collect()} == {i for i in range(30) if i % 3 != 1}
        assert set(values(spark, stored)) == {i for i in range(40) if i % 3 != 1 or i >= 30}
    assert unknown == {fid(2), fid(9), "junk"}


def test_parts_follow_the_rows():
    assert keyed.parts_for(0) == 16 and keyed.parts_for(10**7) == 128 and keyed.parts_for(10**12) == keyed.MOST_PARTS
