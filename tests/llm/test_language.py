import zlib

import numpy as np

from feedloom.llm import language

LETTERS = {"aa": "abcde", "bb": "defgh", "cc": "ghijk"}


def collection(make, prose, n=400):
    names = list(LETTERS)
    return make(*[(i, prose(i, words=15 + i % 100, letters=LETTERS[names[i % 3]]), names[i % 3], "s") for i in range(n)])


def test_held_out_documents(make, prose):
    docs = collection(make, prose)
    rows = language.report(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == list(LETTERS)[r.doc_id % 3] for r in rows if r.held_out]) > 0.98


def test_a_mixed_text_has_the_language_of_its_larger_part(make, prose):
    names, logs = language.learn(collection(make, prose))
    mixed = [prose(900 + i, words=140, letters=LETTERS["aa"]) + " " + prose(950 + i, words=60, letters=LETTERS["cc"]) for i in range(10)]
    rows = language.predict(make(*mixed), names, logs).collect()
    assert {r.lang_pred for r in rows} == {"aa"}
    assert all(0.55 < r.score < 0.85 for r in rows)


def plain_shares(counts, chances, steps=500):
    share = np.full(len(chances), 1 / len(chances))
    for _ in range(steps):
        parts = share[:, None] * chances
        share = (parts / parts.sum(axis=0) * counts).sum(axis=1) / counts.sum()
    return share


def test_mixtures_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(3)
    sizes, chances, counts, want = [7, 1, 40], [], [], []
    for n in sizes:
        c, k = rng.random((3, n)) ** 4 + 1e-4, rng.integers(1, 9, n).astype(float)
        chances.append(c)
        counts.append(k)
        want.append(plain_shares(k, c, language.STEPS))
    share, _ = language._mixture(np.concatenate(chances, axis=1), np.concatenate(counts), np.array(sizes), np.ones((3, 3)))
    assert np.abs(share - np.array(want).T).max() < 0.03


def test_texts_without_letters(make, prose):
    names, logs = language.learn(collection(make, prose))
    rows = language.predict(make((0, None, "aa", "s"), (1, "", "aa", "s"), (2, "12 !? \n", "aa", "s"), (3, "abcab", "aa", "s")), names, logs).collect()
    assert [r.lang_pred for r in sorted(rows)] == ["und", "und", "und", "aa"]


def test_awkward_rows(awkward, make):
    rows = language.report(awkward).collect()
    assert len(rows) == awkward.count() and {r.lang_pred for r in rows} <= {"und", "en", "de", "fr"}
    assert language.report(awkward.limit(0)).count() == 0
    assert {r.lang_pred for r in language.report(make((0, "words", None, "s"))).collect()} == {"und"}
