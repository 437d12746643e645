import json

import pytest
from pyspark.sql import functions as F

from feedloom.operators import embeddings, enrich, search
from tests.tables import articles, at, fid, vectors

ITEMS = "feed_id string, title string, url string, content string, published_at timestamp"


def now():
    return F.lit("2024-01-05 00:00:00").cast("timestamp")


def items(spark, *titles):
    return spark.createDataFrame([(fid(1), t, f"https://{t}", f"content of {t}", None) for t in titles], ITEMS)


def test_answers(spark):
    def answer(score):
        return '{"three_line_summary": "s", "key_takeaways": ["a", null], "quality_score": %s}' % score

    cases = [
        (answer(7), 7, None), (answer(0), 1, None), (answer(11), 10, None), (answer("null"), 1, None),
        ('{"three_line_summary": "s"}', 1, None), (answer("8.5"), None, "bad_response"), (answer("8.0"), None, "bad_response"),
        (answer('"8"'), None, "bad_response"), (answer("8")[:-1], None, "bad_response"), ("[1]", None, "bad_response"),
        (answer("3000000000"), 10, None), (answer("-3000000000"), 1, None), (answer("9223372036854775808"), None, "bad_response"),
        (answer("7") + " trailing", None, "bad_response"), (answer("7") + answer("8"), None, "bad_response"), (" \n" + answer("7") + "\n", 7, None),
        ("words", None, "bad_response"), ("", None, "empty_response"), (None, None, "empty_response"),
    ]
    rows = spark.createDataFrame([(i, c[0], None) for i, c in enumerate(cases)], "i int, response string, error string")
    got = enrich.with_answer(rows).orderBy("i").collect()
    assert [(r.quality_score, r.error) for r in got] == [c[1:] for c in cases]
    assert got[0].key_takeaways == ["a", None] and got[4].key_takeaways is None


def test_offline(spark):
    provider = enrich.OfflineProvider()
    valid, failed = enrich.enrich_items(items(spark, "Test Title"), provider, now())
    row = valid.first()
    assert 1 <= row.quality_score <= 10 and row.quality_score == 8
    assert row.summary.startswith("1. Test Title discusses core concepts.\n2. ") and row.summary.count("• ") == 2
    assert failed.isEmpty()
    made, lost = enrich.embed_articles(valid, provider, now())
    vector = made.first()
    assert vector.article_id == row.id and len(vector.embedding) == 768
    assert vector.embedding[:11] == pytest.approx([0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0])
    assert lost.isEmpty()


def first_answer(client, prompt):
    if "content of slow" in prompt or "content of lost" in prompt:
        raise TimeoutError("quota")
    return json.dumps({"three_line_summary": client, "key_takeaways": [], "quality_score": 99})


def second_answer(client, prompt):
    if "content of lost" in prompt:
        raise ValueError("no answer")
    return json.dumps({"three_line_summary": client, "key_takeaways": [], "quality_score": 3})


def embed(client, text):
    if "second" in text:
        raise ValueError("no vector")
    return [3.0, 4.0, 12.0]


def other_model(client, texts):
    return [[9.0, 9.0, 9.0] for _ in texts]


MODELS = (
    enrich.Model(lambda: "first", enrich.one_by_one(first_answer), enrich.one_by_one(embed)),
    enrich.Model(lambda: "second", enrich.one_by_one(second_answer), other_model),
)


def test_second_model_answers_where_the_first_fails(spark):
    provider = enrich.ModelProvider(MODELS, partitions=3)
    valid, failed = enrich.enrich_items(items(spark, "quick", "slow", "lost", " "), provider, now())
    got = {r.title: (r.summary, r.quality_score) for r in valid.collect()}
    assert got == {"quick": ("first", 10), "slow": ("second", 3)}
    assert {r.title: r.reason for r in failed.collect()} == {"lost": "ValueError: no answer", "": "empty_title"}


def test_an_article_without_a_vector_is_kept(spark):
    provider = enrich.ModelProvider(MODELS)
    valid, _ = enrich.enrich_items(items(spark, "quick", "slow"), provider, now())
    made, lost = enrich.embed_articles(valid, provider, now(), dim=2)
    assert valid.count() == 2
    assert [list(r.embedding) for r in made.collect()] == [pytest.approx([0.6, 0.8])]
    assert [r.reason for r in lost.collect()] == ["ValueError: no vector"]


def test_a_batch_that_fails_is_asked_one_by_one(spark):
    asked = []

    def call(client, texts):
        asked.append(len(texts))
        if any("bad" in t for t in texts):
            raise TimeoutError("late")
        return [t.upper() for t in texts]

    found = enrich._ask(None, call, ["a", "bad", "c"])
    assert found[0::2] == ["A", "C"] and isinstance(found[1], TimeoutError) and asked == [3, 1, 1, 1]
    assert isinstance(enrich._ask(None, lambda client, texts: [], ["a"])[0], ValueError)


def test_vectors_of_another_length_or_kind_are_refused(spark):
    def odd(client, texts):
        return [{"s1": [1.0, 2.0], "s2": [1.0, 2.0, 2.0], "s3": ["x"], "s4": [5.0]}[t] for t in texts]

    provider = enrich.ModelProvider((enrich.Model(lambda: None, odd, odd),))
    table = articles(spark, *[(i, 1, f"u{i}", 5, at()) for i in range(1, 5)]).withColumn("summary", F.concat(F.lit("s"), F.substring("url", 2, 1)))
    made, lost = enrich.embed_articles(table, provider, now(), dim=2)
    assert {r.article_id for r in made.collect()} == {fid(1), fid(2)}
    reasons = {r.article_id: r.reason for r in lost.collect()}
    assert reasons[fid(4)] == "wrong_dimension" and "Arrow" in reasons[fid(3)]
    assert search.nearest(made, [1.0, 2.0], 5).count() == 2


def test_blank_summaries_are_not_embedded(spark):
    rows = articles(spark, (1, 1, "u", 5, at())).withColumn("summary", F.lit(" \n"))
    made, lost = enrich.embed_articles(rows, enrich.OfflineProvider(), now())
    assert made.isEmpty() and [r.reason for r in lost.collect()] == ["blank_text"]


def test_upsert(spark):
    base = vectors(spark, (1, [1], at(1)), (2, [2], at(1)))
    updates = vectors(spark, (2, [20], at(3)), (2, [21], at(4)), (3, [30], at(2)), (2, [22], at(2)))
    odd = vectors(spark, (2, [30, 1], at(9)), (1, [], at(9))).unionByName(vectors(spark, (1, [5], at(9))).withColumn("article_id", F.lit("no id")))
    table, rejected = embeddings.upsert_embeddings(base, updates.unionByName(odd), 1)
    assert sorted(r.reason for r in rejected.collect()) == ["invalid_id", "wrong_dimension", "wrong_dimension"]
    got = {r.article_id: (list(r.embedding), r.created_at) for r in table.collect()}
    assert got == {fid(1): ([1.0], at(1)), fid(2): ([21.0], at(4)), fid(3): ([30.0], at(2))}


def test_equally_late_updates_have_one_winner(spark):
    updates = vectors(spark, (2, [20], at(4)), (2, [21], at(4)), (2, [3], at(4)))
    for rows in (updates, updates.orderBy(F.desc("embedding"))):
        table, _ = embeddings.upsert_embeddings(vectors(spark, (1, [1], at(1))), rows, 1)
        assert {r.article_id: list(r.embedding) for r in table.collect()} == {fid(1): [1.0], fid(2): [21.0]}


def test_redimension(spark):
    table = embeddings.redimension(articles(spark, (1, 1, "u", 5, at())), enrich.OfflineProvider(), 10, "m2", now())
    row = table.first()
    assert (len(row.embedding), row.model) == (10, "m2")
    assert sum(v * v for v in row.embedding) == pytest.approx(1, abs=1e-5)
