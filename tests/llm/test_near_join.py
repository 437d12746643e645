import random

import pytest

from feedloom.llm import near_join
from tests.llm.conftest import rows_of


def shingles(text):
    words = (text or "").split()
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else frozenset()


def brute(rows):
    """doc_id, class, size and links of every row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and 5 * len(a & b) >= 4 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(root(i), []).append(i)
    out = []
    for members in classes.values():
        known = [rows[i][0] for i in members if rows[i][0] is not None]
        out += [(rows[i][0], min(known, default=None), len(members), links[i]) for i in members]
    return sorted(out, key=repr)


def changed(text, rng, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.fixture
def corpus(make, prose):
    rng, texts = random.Random(5), []
    for i in range(60):
        text = prose(i, words=rng.randint(30, 200))
        texts.append(text)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            texts.append(changed(text, rng, rng.choice([0, 1, 1, 2, 6])))
    passage = prose(999, words=60)
    texts += [f"{prose(1000 + i, words=40)} {passage}" for i in range(60)]
    rng.shuffle(texts)
    return make(*texts)


def test_classes_are_those_of_all_pairs(corpus):
    want = brute([(r.doc_id, r.text) for r in corpus.collect()])
    assert [x[:3] for x in rows_of(near_join.report(corpus))] == [x[:3] for x in want]


def test_no_link_outside_and_nearly_all_inside(corpus):
    want = {x[0]: x[3] for x in brute([(r.doc_id, r.text) for r in corpus.collect()])}
    found = {r.doc_id: r.n_links for r in near_join.report(corpus).collect()}
    assert all(found[i] <= want[i] for i in want)
    assert sum(found.values()) >= 0.9 * sum(want.values())


def test_the_depth_meets_the_recall():
    depth = near_join.depth_for(0.999, 0.8, 16, 16)
    assert 1 - (1 - 0.8**depth) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** 16


def test_a_large_group_of_near_copies_is_one_class(make, prose):
    rng, text = random.Random(8), prose(3, words=150)
    docs = make(*[changed(text, rng, 2) for _ in range(400)], *[prose(50 + i) for i in range(50)])
    rows = near_join.report(docs.repartition(9)).collect()
    assert {r.class_id for r in rows if r.doc_id < 400} == {0}
    assert all(r.class_id == r.doc_id and r.n_links == 0 for r in rows if r.doc_id >= 400)


def test_components_of_a_long_chain(spark):
    names = [random.Random(i).randbytes(16) for i in range(300)]
    edges = list(zip(names[:199], names[1:200])) + list(zip(names[200:299], names[201:]))
    edges = [(min(e), max(e)) for e in edges]
    found = near_join.components(spark.createDataFrame(edges, "a binary, b binary")).collect()
    labels = {bytes(r.node): bytes(r.label) for r in found}
    assert {labels[n] for n in names[:200]} == {min(names[:200])}
    assert {labels[n] for n in names[200:]} == {min(names[200:])}


def test_awkward_rows(awkward):
    want = brute([(r.doc_id, r.text) for r in awkward.collect()])
    assert rows_of(near_join.report(awkward)) == want
    assert near_join.report(awkward.limit(0)).count() == 0
    assert near_join.kept(awkward.limit(0)).count() == 0


def test_one_document_of_each_class_stays(corpus, awkward):
    classes = {x[1] for x in brute([(r.doc_id, r.text) for r in corpus.collect()])}
    assert {r.doc_id for r in near_join.kept(corpus).collect()} == classes
    kept = near_join.kept(awkward)
    assert kept.schema == awkward.schema
    assert [r.doc_id for r in kept.collect() if r.text and r.text.startswith("same")] == [1]


def test_of_a_repeated_row_one_stays(make):
    docs = make((2, "a b c d e f g h", "en", "s"), (2, "a b c d e f g h", "en", "s"), (2, "a b c d e f g h", "de", "s"))
    assert near_join.kept(docs).count() == 1


def crowd(make, prose, tails):
    """Near copies in twos, all with one passage and so most with one prefix; whether each two share it."""
    passage, texts = prose(1, words=100), []
    for i in range(300):
        text = f"{passage} {prose(10 + i, words=tails[i % len(tails)])}"
        texts += [text, f"{text} end{i}"]
    docs = make(*texts)
    keys = {r.doc_id: r["keys"] for r in near_join._prepared(docs, 1, 1).collect()}
    return docs, {i: int(keys[i] == keys[i ^ 1]) for i in keys}


def test_all_pairs_of_a_crowded_prefix_are_compared(make, prose):
    docs, want = crowd(make, prose, [40])
    found = near_join.classified(docs, trees=1, values=1, recall=0.0)
    assert {r.doc_id: r.n_links for r in found.collect()} == want
    assert sum(want.values()) > 500


def test_links_in_a_large_group_are_counted_exactly(make, prose):
    rng, text = random.Random(11), prose(4, words=150)
    docs = make(*[changed(text, rng, 1) for _ in range(300)], *[text] * 3)
    assert rows_of(near_join.report(docs.repartition(7))) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_partners_behind_neighbours_of_other_sizes_are_met(make, prose):
    docs, want = crowd(make, prose, [40, 110, 220, 400])
    found = near_join.classified(docs, trees=1, values=1, recall=0.0)
    assert {r.doc_id: r.n_links for r in found.collect()} == want


def test_rows_of_a_linked_id_that_are_not_linked_stay(make, prose):
    near = [prose(1), f"{prose(1)} end", f"{prose(1)} more end"]
    rows = [(1, near[0], "en", "s"), (None, near[1], "en", "s"), (None, prose(2), "en", "s"), (None, None, "en", "s")]
    rows += [(5, near[2], "en", "s"), (5, prose(3), "en", "s"), (6, prose(4), "en", "s"), (None, prose(5), "en", "s"), (None, f"{prose(5)} end", "en", "s")]
    stay = near_join.kept(make(*rows)).collect()
    texts = sorted(str(r.text) for r in stay)
    fives = [t for t in texts if t.startswith(prose(5))]
    assert len(fives) == 1
    assert texts == sorted([near[0], prose(2), "None", prose(3), prose(4), *fives])


def test_the_trees_meet_the_recall():
    trees = near_join.trees_for(0.999, 0.8, 8)
    assert 1 - (1 - 0.8**8) ** trees >= 0.999 > 1 - (1 - 0.8**8) ** (trees - 1)


def passage_crowd(make, prose, unlike=300):
    """Texts that share a passage and little else, a few of them with a near copy."""
    passage, texts = prose(1, words=60), []
    for i in range(unlike):
        texts.append(f"{passage} {prose(10 + i, words=90)}")
        if i % 20 == 0:
            texts.append(f"{texts[-1]} end{i}")
    return make(*texts)


def pairs_compared(members):
    return sum(n * (n - 1) // 2 for n in (r["count"] for r in members.groupBy("at").count().collect()))


def test_a_crowd_of_unlike_sets_gets_longer_prefixes(make, prose, monkeypatch):
    docs = passage_crowd(make, prose)
    monkeypatch.setattr(near_join, "CROWD", 1 << 40)
    before = pairs_compared(near_join.filed(docs)[2])
    monkeypatch.setattr(near_join, "CROWD", 8)
    after = pairs_compared(near_join.filed(docs)[2])
    assert 4 * after < before
    assert rows_of(near_join.report(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_a_crowd_of_similar_sets_keeps_its_prefix(make, prose, monkeypatch):
    rng, text = random.Random(12), prose(6, words=150)
    docs = make(*[changed(text, rng, 1) for _ in range(200)], *[prose(60 + i) for i in range(20)])
    monkeypatch.setattr(near_join, "CROWD", 100)
    prepared, nodes, _ = near_join.filed(docs)
    assert {len(r["keys"]) for r in nodes.collect()} == {near_join.TREES}
    assert rows_of(near_join.report(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_crowds_of_awkward_rows(awkward, corpus, make, prose, monkeypatch):
    monkeypatch.setattr(near_join, "CROWD", 2)
    assert rows_of(near_join.report(awkward)) == brute([(r.doc_id, r.text) for r in awkward.collect()])
    want = brute([(r.doc_id, r.text) for r in corpus.collect()])
    assert [x[:3] for x in rows_of(near_join.report(corpus))] == [x[:3] for x in want]
    crowd = passage_crowd(make, prose, 40).unionByName(awkward.select("doc_id", "text", "lang", "source"), allowMissingColumns=True)
    assert rows_of(near_join.report(crowd)) == brute([(r.doc_id, r.text) for r in crowd.collect()])
