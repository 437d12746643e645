import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from texts or from (doc_id, text, lang, source)."""

    def build(*rows, more=""):
        full = [(i, r, "en", "s") if not isinstance(r, tuple) else r for i, r in enumerate(rows)]
        data = [(*r[:4], len(r[1] or ""), *r[4:]) for r in full]
        return spark.createDataFrame(data, DOCS + more)

    return build


@pytest.fixture
def awkward(make):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, "same text of a few words here", "en", "a"),
        (2, "same text of a few words here", "en", "a"),
        (2, "same text of a few words here", "en", "a"),
        (3, None, None, None),
        (4, "", "en", "b"),
        (None, "same text of a few words here", None, "a"),
        (None, None, None, None),
        (5, long, "de", None),
        (6, " \t\n ", "fr", "b"),
        (7, "Ünïcödé wörds, and 数字 mixed in with it all", "de", "c"),
        (7, "another text under the same id, with enough words in it", "de", "c"),
    ]
    return make(*[(*r, "x", 1, True, "y") for r in rows], more=", kept string, copies int, node boolean, label string")


@pytest.fixture
def prose():
    """Invented text, the same for a seed."""

    def build(seed, words=120, letters="abcdefgh"):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(words))

    return build


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns or frame.columns).collect()), key=repr)
