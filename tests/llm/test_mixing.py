import numpy as np
from pyspark.sql import functions as F

from feedloom.llm import mixing
from tests.llm.conftest import rows_of


def test_pairs_keep_the_words_and_leave_one_fraction():
    rng = np.random.default_rng(1)
    sizes, fractions = rng.integers(1, 500, 3000), rng.random(3000)
    after = mixing.pivotal(sizes, fractions, rng.random(3000))
    open_ = (after > 0) & (after < 1)
    assert open_.sum() <= 1
    assert np.isclose((after * sizes).sum(), (fractions * sizes).sum())


def test_every_document_keeps_its_chance():
    rng = np.random.default_rng(2)
    sizes, fractions = np.array([5, 80, 13, 40, 7]), np.array([0.2, 0.5, 0.7, 0.35, 0.9])
    runs = np.array([mixing.pivotal(sizes, fractions, rng.random(5)) for _ in range(20_000)])
    assert np.abs(runs.mean(axis=0) - fractions).max() < 0.015


def brute_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    mass, capped = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = mass - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        above = {s: most * sizes[s] for s in free if target[s] > most * sizes[s] + 1e-9}
        if not above:
            return target | capped
        capped |= above


def collection(make, prose):
    rows = []
    for i in range(900):
        source = "big" if i % 3 else [None, "a", "ä", "b", "￿", "𝄞", "c"][i % 7]
        rows.append((i, prose(i, words=(i * 37) % 90), "en", source))
    return make(*rows)


def test_the_mix_meets_its_targets(make, prose):
    docs = collection(make, prose)
    plan = mixing.planned(docs, block=16).toPandas()
    sizes = {s: int(g["size"].sum()) for s, g in plan.groupby(plan.source.map(lambda s: s or "\0"))}
    sizes = {None if s == "\0" else s: n for s, n in sizes.items()}
    want = brute_targets(sizes, mixing.WEIGHTS, mixing.SHARE, mixing.MOST_COPIES)
    words = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}
    assert dict(zip(plan.doc_id, plan["size"])) == words
    assert plan.copies.between(0, 2).all()
    for source, group in plan.groupby(plan.source.map(lambda s: s or "\0")):
        source = None if source == "\0" else source
        assert np.allclose(group.target, want[source])
        assert (group.source_size == sizes[source]).all()
        assert abs((group.copies * group["size"]).sum() - want[source]) <= group["size"].max()


def test_reruns_agree_however_the_rows_lie(make, prose):
    docs = collection(make, prose)
    again = mixing.report(docs.repartition(7, "text"))
    assert rows_of(mixing.report(docs)) == rows_of(again)


def test_word_counts(make):
    texts = ["", " ", "a", " a b\t\nc ", "a\x0bb\x0cc\rd", "a b", None, "  two  words"]
    docs = make(*[(i, t, "en", "s") for i, t in enumerate(texts)])
    found = [r.n for r in docs.orderBy("doc_id").select(mixing.word_count(F.col("text")).alias("n")).collect()]
    assert found == [0, 0, 1, 3, 4, 1, 0, 2]


def test_awkward_rows(awkward):
    plan = mixing.planned(awkward)
    assert plan.count() == awkward.count()
    wanted = plan.agg(F.sum("copies")).first()[0]
    mixed = mixing.mixed(awkward)
    assert mixed.schema == awkward.schema and mixed.count() == wanted
    empty = awkward.limit(0)
    assert mixing.report(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_the_mix_repeats_documents(make, prose):
    docs = collection(make, prose)
    plan = {r.doc_id: r.copies for r in mixing.planned(docs).collect()}
    found = {r.doc_id: r.n for r in mixing.mixed(docs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert found == {i: n for i, n in plan.items() if n}
