import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import exact_dedup, fuse
from feedloom.operators import joins
from tests.llm.conftest import rows_of


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 20_000])
def test_a_filter_finds_its_keys_and_hardly_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(2**63), 2**63 - 1, n)
    built = fuse.build(np.concatenate([keys, keys]))
    assert fuse.contains(keys, *built).all()
    assert fuse.contains(rng.integers(-(2**63), 2**63 - 1, 50_000), *built).mean() < 0.001


@pytest.fixture(params=[joins.BROADCAST_ROWS, 0], ids=["broadcast", "shuffled"])
def either_way(request, monkeypatch):
    """Keys may be broadcast, or are too many for that."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", request.param)


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, taken = max(known, default=None), False
        for i in sorted(ids, key=repr):
            kept = i == keep and not taken
            taken = taken or kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def weak(text):
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 2))


@pytest.mark.parametrize("split", ["false", "true", "doc_id < 3"])
def test_awkward_rows(awkward, split):
    found = exact_dedup.classify(awkward, F.expr(split))
    found = found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    assert rows_of(found) == expected([(r.doc_id, r.text) for r in awkward.collect()])


def test_the_query_splits_by_itself(awkward, either_way):
    found = exact_dedup.report(awkward).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(found) == expected([(r.doc_id, r.text) for r in awkward.collect()])
    assert exact_dedup.report(awkward.limit(0)).count() == 0


def test_colliding_digests_are_taken_apart_by_text(make, either_way):
    docs = make(*[f"text {i % 700}" for i in range(1500)])
    found = exact_dedup.classify(docs, F.col("doc_id") < 500, weak).select("doc_id", "keep_id", "group_size", "kept")
    want = [x[:4] for x in expected([(r.doc_id, r.text) for r in docs.collect()])]
    assert rows_of(found) == sorted(want, key=repr)


def test_kept_rows_have_all_their_columns(awkward, either_way):
    kept = exact_dedup.kept(awkward, F.col("doc_id") < 3)
    assert kept.schema == awkward.schema
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in awkward.collect()})
    assert exact_dedup.kept(awkward.limit(0), F.lit(False)).count() == 0


def test_of_repeated_ids_with_other_columns_one_row_stays(make, either_way):
    docs = make((1, "a", "en", "x"), (1, "a", "de", "y"), (1, "a", "de", "y"), (0, "a", "en", "z"))
    assert exact_dedup.kept(docs, F.lit(False)).count() == 1
