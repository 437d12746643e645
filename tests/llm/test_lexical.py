import math
import re
from collections import Counter

import numpy as np
import pytest

from feedloom.llm import lexical

ITEMS = "item_id long, text string, score int"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def tokens(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(folded)


def brute(docs, items, k=10):
    bags = [(i, Counter(tokens(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(tokens(text))
    rows = []
    for item, terms in asked.items():
        found = []
        for doc, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms if t in bag)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        rows += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(rows, key=repr)


def compared(spark, docs, items, k=10):
    asked = spark.createDataFrame([(*i, 1) for i in items], ITEMS)
    found = lexical.search(lexical.index(docs), asked, k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    ours = sorted((tuple(r) for r in found.collect()), key=repr)
    assert ours == brute([(r.doc_id, r.text) for r in docs.collect()], items, k)
    return ours


def test_terms():
    for text in ("Ab c-d_é  Ünd １２ x\x7fy\x00z", "", " .,", "ÀB C a b", "don't 3.14 数字,字"):
        assert [t.decode() for t in lexical.terms_of(text.encode())] == tokens(text)


def test_equals_brute_force(spark, make, prose):
    docs = make(*[prose(i % 190, words=5 + i * 13 % 300, letters="abc") for i in range(400)]).repartition(3)
    items = [(i, prose(i * 7, words=30, letters="abc")) for i in range(25)]
    assert len(compared(spark, docs, items)) == 250


def test_items_come_in_blocks(spark, make, prose, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    monkeypatch.setattr(lexical, "_BYTES", 1 << 14)
    docs = make(*[prose(i, words=60, letters="ab") for i in range(120)])
    compared(spark, docs, [(i, prose(i, words=20, letters="ab")) for i in range(9)], k=3)


def test_bounds_hold_and_prune(prose):
    texts = [prose(i, words=200, letters="abcdef") for i in range(300)]
    item = " ".join(texts[17].split()[:40])
    bags = [Counter(lexical.terms_of(t.encode())) for t in texts]
    bags[3] = Counter({w: 300 if i == 0 else c for i, (w, c) in enumerate(bags[3].items())})  # more than a byte holds
    terms = sorted(set(item.split()))
    entries = np.column_stack([np.arange(len(terms)), np.zeros(len(terms)), np.full(len(terms), 5000)]).astype(np.int64)
    block = lexical._Block(terms, entries, 1)
    sizes = np.array([len(b) for b in bags])
    counts = np.array([c for b in bags for c in b.values()])
    hashes = np.array([lexical.zlib.crc32(w) for b in bags for w in b])
    flat, widths = lexical._folded(hashes, counts, sizes)
    norm, starts, best = np.full(300, 100), np.cumsum(widths) - widths, []
    for i, bag in enumerate(bags):
        bound = lexical.bounds(block, flat[starts[i] : starts[i] + widths[i]][None], norm[i : i + 1])[0, 0]
        score = sum(5000 * int(lexical.impacts(np.array([bag[t.encode()]]), norm[:1])[0]) for t in terms)
        assert bound >= score
        best.append((bound, score))
    reach = sorted((s for _, s in best), reverse=True)[0]
    assert sum(b >= reach for b, _ in best) < 30


def test_waves_score_few_documents(spark, make, prose):
    texts = [prose(i, words=150, letters="abcdef") for i in range(600)]
    found = lexical.index(make(*texts).coalesce(1)).toArrow().combine_chunks().to_batches()[0]
    item = " ".join(texts[9].split()[:30])
    terms = sorted(set(item.split()))
    entries = np.column_stack([np.arange(len(terms)), np.zeros(len(terms)), np.full(len(terms), 4000)]).astype(np.int64)
    best = lexical._Best(1, 1)
    scored = lexical._searched(lexical._Block(terms, entries, 1), best, found, 600, 600 * 150)
    assert scored < 100 and best.rows[0][0][1] == 9


def test_ties_repeats_and_nulls(spark, make, awkward, prose):
    same = "alpha beta gamma"
    docs = make(*[(i % 15, same, "en", "s") for i in range(30)], (None, same, "en", "s"), (50, "delta alpha", "en", "s"))
    compared(spark, docs, [(1, "Alpha BETA"), (None, "gamma"), (2, None), (3, ""), (4, "unknown"), (1, "delta"), (1, "delta")])
    compared(spark, awkward, [(1, "same text of wörds w1x1"), (2, "数字 here")])


@pytest.mark.parametrize("side", ["docs", "items", "both"])
def test_empty_tables(spark, make, side):
    docs, items = make("some text"), spark.createDataFrame([(1, "text", 1)], ITEMS)
    found = lexical.report(docs.limit(0) if side != "items" else docs, items.limit(0) if side != "docs" else items)
    assert found.count() == 0 and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_other_ids(spark):
    docs = spark.createDataFrame([("x", "one two"), ("y", "two two three")], "doc_id string, text string")
    found = lexical.report(docs, spark.createDataFrame([("q", "three")], "item_id string, text string")).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in found] == [("q", 1, "y")]
