import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import sharding
from feedloom.session import shared_folder


def gapless(rows):
    places = {}
    for r in rows:
        places.setdefault(r.shard, []).append(r.slot)
    return all(sorted(p) == list(range(len(p))) for p in places.values())


def near_equal(rows, shards=sharding.SHARDS):
    """Apart by no more than the largest record, which cannot be divided."""
    sizes = np.bincount([r.shard for r in rows], [r.size for r in rows], shards)
    return sizes.max() - sizes.min() <= max(r.size for r in rows)


def test_every_row_is_placed(make, prose):
    docs = make(*[(i, prose(i, words=1 + i * 31 % 400), "en", "s") for i in range(700)]).repartition(5)
    rows = sharding.report(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    assert gapless(rows) and near_equal(rows)


def test_an_id_with_a_third_of_all_rows_is_split(make, prose):
    docs = make(*[(7 if i % 3 else i, prose(1 if i % 3 else i, words=60), "en", "s") for i in range(3000)]).repartition(4)
    rows = sharding.report(docs).collect()
    assert len(rows) == 3000 and gapless(rows)
    assert len({r.virtual_slot for r in rows if r.doc_id == 7}) == 1
    sizes = np.bincount([r.shard for r in rows], [r.size for r in rows], 16)
    assert sizes.max() < 1.05 * sizes.mean()


def test_an_edit_moves_few_slots():
    rng = np.random.default_rng(3)
    weights = rng.integers(1, 1000, 4096)
    first = sharding.rebalanced(sharding.first_map(), weights)
    load = sharding.loads(first, weights)
    assert load.max() - load.min() < 0.001 * load.mean()
    heavier = weights + np.where(first.owner == 5, weights // 2, 0)
    second = sharding.rebalanced(first, heavier)
    load = sharding.loads(second, heavier)
    assert second.version == first.version + 1 and load.max() - load.min() < 0.001 * load.mean()
    assert (second.owner != first.owner).mean() < 0.08


def test_a_new_shard_takes_slots_only_into_itself():
    weights = np.random.default_rng(4).integers(1, 1000, 4096)
    old = sharding.rebalanced(sharding.first_map(), weights)
    new = sharding.grown(old, weights)
    changed = new.owner != old.owner
    assert (new.owner[changed] == 16).all() and new.shards == 17
    load = sharding.loads(new, weights)
    assert 0.95 * load.mean() < load[16] <= load.mean()
    # the law of whole maps: what follows is balanced again
    load = sharding.loads(sharding.rebalanced(new, weights), weights)
    assert load.max() - load.min() < 0.001 * load.mean()


def test_maps_are_kept_by_version(spark):
    folder = shared_folder(spark, "slot-map")
    old = sharding.split(sharding.first_map(4, 8), {3: 3})
    new = sharding.rebalanced(old, np.arange(10))
    sharding.write_map(spark, old, folder)
    sharding.write_map(spark, new, folder)
    stored = {r.virtual_slot: r.owners for r in sharding.read_map(spark, folder, 0).collect()}
    assert stored == {s: [s % 4] * (3 if s == 3 else 1) for s in range(8)}
    again = {(r.virtual_slot, p): o for r in sharding.read_map(spark, folder, 1).collect() for p, o in enumerate(r.owners)}
    assert again == dict(zip(zip(new.slot.tolist(), new.part.tolist()), new.owner.tolist()))
    with pytest.raises(Exception):
        sharding.write_map(spark, new, folder)


def test_awkward_rows(awkward):
    rows = sharding.report(awkward).collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == sorted((r.doc_id or 0, len((r.text or "").encode()) + 1) for r in awkward.collect())
    assert gapless(rows) and {r.text_crc32 for r in rows if r.size == 1} == {0}
    empty = sharding.report(awkward.limit(0))
    assert empty.count() == 0
    assert dict(empty.dtypes) == dict(sharding.report(awkward).dtypes)


def test_texts_are_not_shuffled(make, prose):
    rows = sharding.slotted(make(prose(1), prose(2)))
    assert rows.columns == ["doc_id", "size", "text_crc32", "block", "row", "virtual_slot"]
    assert rows.select(F.max("virtual_slot")).first()[0] < sharding.SLOTS
