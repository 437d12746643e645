import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from feedloom.llm import toxicity

BAD = ("grobbel", "snark vile", "zut alors")


def collection(spark, make, prose, n=900):
    rng, rows, labels = random.Random(4), [], []
    common = {"en": "the of and to in", "de": "der die und das ist", "fr": "le les et des est", "es": "el los que una por"}
    for i in range(n):
        lang = rng.choice(list(common))
        words = (prose(i, words=rng.randint(20, 150)) + " " + f"{common[lang]} " * 5).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), lang, "s"))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    return make(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_apart(spark, make, prose):
    docs, labels = collection(spark, make, prose)
    rows = toxicity.report(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    right = [r.predicted == (r.doc_id % 5 == 0) for r in held]
    assert len(held) > 100 and np.mean(right) > 0.95


def test_labels_of_held_out_rows_are_not_learned(spark, make, prose):
    docs, labels = collection(spark, make, prose)
    turned = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    score = lambda t: {r.doc_id: r.score for r in toxicity.report(docs, t).collect()}
    assert score(labels) == score(turned)


def test_a_long_text_is_scored_whole(spark, make, prose):
    docs, labels = collection(spark, make, prose)
    net = toxicity.train(docs, labels)
    scorer = toxicity._Scorer(net)
    text = prose(77, words=250_000)
    plain, late = scorer.logits(scorer.read([text, text + " grobbel grobbel snark vile"])[0])
    assert late > plain
    # blocks change nothing
    words = scorer.read([prose(5, words=500)])[0]
    whole = scorer.logits(words)
    old, toxicity._BLOCK = toxicity._BLOCK, 40
    try:
        assert np.allclose(scorer.logits(words), whole, atol=1e-4)
    finally:
        toxicity._BLOCK = old


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(1, 1, 1), (3, None, None), (None, 0, 1), (4, 0, 0), (4, 0, 0), (5, 1, 0), (6, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0), labels.filter("toxic = 0")):
        rows = toxicity.report(awkward, known).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.report(awkward.limit(0), labels).count() == 0


def test_every_labelled_text_is_learned_whole(spark, make, prose, monkeypatch):
    """Words of few rows, and words behind the first 10,000 characters, are known, whatever the number of rows."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 500)
    rows, labels = [], []
    for i in range(6000):
        toxic = i % 2
        words = f"plain words of row {i % 50}" + (" grobbel" if toxic else "")
        if i >= 5960 and toxic:
            words = "seldom " * 2 + "lateword" if i % 4 == 1 else prose(i, words=2500) + " farbehind"
        rows.append((i, words, "en", "s"))
        labels.append((i, 1, toxic))
    docs = make(*rows)
    net = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    known = net.buckets(["grobbel", "lateword", "farbehind", "unheard"])[:, 0] < toxicity.BUCKETS
    assert known.tolist() == [True, True, True, False]
    scorer = toxicity._Scorer(net)
    bad, good = scorer.logits(scorer.read(["plain words grobbel", "plain words of row 7"])[0])
    assert bad > net.cuts.max() and good < net.cuts.min()


def test_shards_train_one_net(spark, make, prose, monkeypatch):
    docs, labels = collection(spark, make, prose, n=1500)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 200)
    held = [r for r in toxicity.report(docs, labels).collect() if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95


def test_portions_are_read_a_few_at_a_time(spark, monkeypatch):
    """Rows of megabytes: neither a row group, which a reader holds whole, nor a batch for Python gathers all of a shard."""
    paths, own = [], toxicity.staged
    monkeypatch.setattr(toxicity, "staged", lambda *a, **b: paths.append(own(*a, **b)) or paths[-1])
    docs = spark.range(1600).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 160), x -> sha2(concat(id, ' ', x), 256))) AS text")
    docs = docs.selectExpr("doc_id", "concat(text, ' ', replace(text, 'a', ' ')) AS text")
    toxicity.report(docs, spark.range(1600).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS toxic"))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in paths[-1].inputFiles()]
    groups = [f.row_group(g) for f in files for g in range(f.num_row_groups)]
    assert sum(g.total_byte_size for g in groups) > 12 << 20 and max(g.total_byte_size for g in groups) < 8 << 20

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    found = [r[0] for r in paths[-1].coalesce(1).mapInArrow(sizes, "bytes long").collect()]
    assert sum(found) > 12 << 20 and max(found) < 12 << 20


def test_what_shards_and_tasks_exchange_is_small(spark, make, prose):
    """Changes of vectors go in steps, close to what they were, and texts compressed and whole."""
    rng = np.random.default_rng(3)
    before = toxicity._State.new(np.zeros(1, np.uint8))
    after = before.copy()
    met = np.flatnonzero(rng.random(toxicity.BUCKETS) < 0.5)
    for _ in range(3):
        after.step("vectors", rng.normal(0, 0.02, (len(met), toxicity.SIZE)).astype(np.float32), met)
    after.step("bias", np.ones_like(after.net.bias))
    whole, small = dict(after.parts(before, True)), dict(after.parts(before, False))
    assert sum(map(len, small.values())) < 0.35 * len(met) * 33 * 4
    exact = before.changed({k: toxicity._opened_part(k, p, True) for k, p in whole.items()})
    near = before.changed({k: toxicity._opened_part(k, p, False) for k, p in small.items()})
    assert np.allclose(exact.net.vectors, after.net.vectors, atol=1e-6) and np.allclose(exact.sums["vectors"], after.sums["vectors"], rtol=1e-4)
    assert np.allclose(exact.net.bias, after.net.bias) and np.array_equal(exact.net.bias, near.net.bias)
    off = np.abs(near.net.vectors - exact.net.vectors).max(axis=1)
    assert (off <= np.abs(exact.net.vectors - before.net.vectors).max(axis=1) / 250 + 1e-6).all()
    assert np.allclose(near.sums["vectors"], exact.sums["vectors"], rtol=0.03, atol=1e-4)

    texts = {i: prose(i % 7, words=300) + (" Ünïcödé 数字 🎉" if i % 2 else "") for i in range(40)}
    docs = make(*[(i, t, "en", "s") for i, t in texts.items()] * 2)
    rows = toxicity._labelled(docs, spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int"))
    found = [(zlib.decompress(r.packed).decode(), r.label) for r in rows.collect()]
    want = [(t, i % 2) for i, t in texts.items() if zlib.crc32(str(i).encode()) % 4 != 2]
    assert found == want
    assert sum(len(r.packed) for r in rows.collect()) < 0.7 * sum(len(t.encode()) for t, _ in want)
