import datetime

from pyspark.sql import functions as F

from feedloom.operators import constraints, ingest
from tests.tables import articles, at, feeds, fid, vectors

ITEMS = "feed_id string, feed_name string, item_pos long, title string, url string, content string, published_at timestamp"


def items(spark, *rows):
    """(feed number, feed name, position, title, url)"""
    return spark.createDataFrame([(fid(f), n, p, t, u, f"c{f}{p}", None) for f, n, p, t, u in rows], ITEMS)


def test_first_per_url_takes_feeds_by_name_and_items_by_position(spark):
    rows = items(spark, (1, "zeta", 0, "z", "u"), (2, "alpha", 7, "a7", "u"), (2, "alpha", 3, "a3", "u"), (1, "zeta", 1, "v", "v"))
    got = {r.url: (r.title, r.content) for r in ingest.first_per_url(rows).collect()}
    assert got == {"u": ("a3", "c23"), "v": ("v", "c11")}


def test_an_item_that_cannot_be_stored_does_not_hide_its_url(spark):
    rows = items(spark, (2, "alpha", 0, " ", "u"), (2, "alpha", 1, "x" * 1025, "u"), (1, "zeta", 0, "good", "u"))
    known = feeds(spark, (1, "https://a", "zeta", True), (2, "https://b", "alpha", True))
    fresh = ingest.new_items(rows, articles(spark), known)
    assert [r.title for r in fresh.collect()] == ["good"]
    _, rejected = ingest.split_storable(rows)
    assert sorted(r.reason for r in rejected.collect()) == ["empty_title", "title_too_long"]


def test_known_urls_and_unknown_feeds_are_left_out(spark):
    rows = items(spark, (1, "a", 0, "t", "old"), (1, "a", 1, "t", "new"), (9, "gone", 0, "t", "orphan"))
    known = feeds(spark, (1, "https://a", "a", True))
    fresh = ingest.new_items(rows, articles(spark, (5, 1, "old", 5, at())), known)
    assert [r.url for r in fresh.collect()] == ["new"]
    assert [r.url for r in ingest.of_unknown_feeds(rows, known).collect()] == ["orphan"]
    counts = {r.feed_id: (r.items_checked, r.new_articles) for r in ingest.run_counters(rows, fresh).collect()}
    assert counts == {fid(1): (2, 1), fid(9): (1, 0)}
    assert {r.url: r.n for r in ingest.url_counts(articles(spark, (5, 1, "old", 5, at()))).collect()} == {"old": 1}


def test_normalise(spark):
    schema = "title string, link string, content string, description string, published timestamp, updated timestamp"
    d = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame(
        [(" T ", " u ", "<p>x</p>", "d", None, d), ("T", "v", "\n", "<i>d</i>", d, None), ("T", "　", "x", "d", d, d), (None, "w", None, None, None, None)],
        schema,
    )
    got = {r.url: (r.title, r.content, r.published_at) for r in ingest.normalise_items(rows).collect()}
    assert got == {"u": ("T", "x", d), "v": ("T", "d", d), "w": ("", "", None)}


def test_insert_gives_ids_that_stay_the_same(spark):
    rows = items(spark, (1, "a", 0, "t", "u")).withColumns({"summary": F.lit("s"), "quality_score": F.lit(8)})
    made = ingest.to_articles(rows, F.lit("2024-01-02").cast("timestamp"))
    table = ingest.insert_articles(articles(spark, (5, 1, "old", 5, at())), made)
    assert table.count() == 2 and made.first().id == made.first().id
    assert made.first().raw_content == "c10"


def test_rule_report_counts_each_broken_rule(spark):
    known = feeds(spark, (1, "https://a", "n", True), (2, "https://a", "x" * 256, True))
    stored = articles(spark, (1, 1, "u", 5, at()), (2, 9, "u", 0, at()), (3, 1, "v" * 2049, 11, at()))
    kept = vectors(spark, (1, [1, 2], at()), (1, [1], at()), (8, [1, 2], at()))
    asked = spark.createDataFrame([("ok",), (" ",), (None,)], "query string")
    got = {r.rule: r.broken for r in constraints.rule_report(known, stored, kept, asked, 2).collect()}
    assert got == {
        "feed_url_unique": 1, "article_url_unique": 1, "feed_text_length": 1, "article_text_length": 1, "score_range": 2,
        "article_feed_exists": 1, "embedding_article_exists": 1, "embedding_unique": 1, "embedding_dimension": 1,
        "feed_id_uuid": 0, "article_id_uuid": 0, "search_text": 2,
    }


def test_split_embeddings(spark):
    rows = spark.createDataFrame([(fid(1), [1.0, 2.0]), ("junk", [1.0, 2.0]), (fid(2), [1.0]), (fid(3), None)], "article_id string, embedding array<float>")
    good, bad = constraints.split_embeddings(rows, 2)
    assert [r.article_id for r in good.collect()] == [fid(1)]
    assert {r.article_id: r.reason for r in bad.collect()} == {"junk": "invalid_id", fid(2): "wrong_dimension", fid(3): "wrong_dimension"}
