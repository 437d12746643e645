from pyspark.sql import functions as F

from feedloom.operators import registry
from tests.tables import articles, at, feeds, fid, vectors

NOW = "2024-01-05 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def three(spark):
    return feeds(spark, (1, "https://a", "b-feed", True), (2, "https://b", "a-feed", True), (3, "https://c", "c-feed", False))


def add(spark, stored, *requests):
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], "request_no long, url string, name string, discovered string")
    change = registry.add_feeds(stored, rows, now())
    rejected = {r.request_no: r.reason for r in change.rejected.collect()}
    return change.table, rejected


def test_scans_and_lookups(spark):
    table = three(spark)
    assert [r.name for r in registry.active_feeds(table).collect()] == ["a-feed", "b-feed"]
    assert [r.id for r in registry.newest_feeds(table).collect()] == [fid(3), fid(2), fid(1)]
    assert registry.find_by_id(table, fid(2).upper()).first().url == "https://b"
    assert registry.find_by_id(table, "non-existent-id").isEmpty()
    assert registry.find_feed_by_url(table, "https://c").first().id == fid(3)
    assert registry.find_feed_by_url(table, "https://zzz").isEmpty()
    wanted = spark.createDataFrame([("https://a",), ("https://zzz",)], "url string")
    assert {r.url: r.name for r in registry.lookup_by_url(table, wanted).collect()} == {"https://a": "b-feed", "https://zzz": None}


def test_add_given_discovered_conflict(spark):
    table, rejected = add(
        spark, three(spark).limit(0),
        ("https://news.example.org/rss", "Daily News", None),
        ("https://example.com/rss", "", "Its Own Title"),
        (" https://news.example.org/rss ", "again", None),
        ("https://untitled/rss", " ", ""),
        ("not-a-valid-url", "Invalid Feed", None),
        ("  ", "no url", None),
    )
    assert {r.url: r.name for r in table.collect()} == {
        "https://news.example.org/rss": "Daily News",
        "https://example.com/rss": "Its Own Title",
        "https://untitled/rss": "https://untitled/rss",
    }
    assert all(r.is_active and str(r.created_at) == NOW for r in table.collect())
    assert rejected == {2: "conflict", 4: "invalid_url", 5: "invalid_url"}


def test_the_conflict_is_checked_before_the_rest(spark):
    _, rejected = add(spark, three(spark), ("https://a", "x" * 300, None), ("https://a", "ok", None))
    assert rejected == {0: "conflict", 1: "conflict"}


def test_a_failed_request_does_not_block_a_later_one(spark):
    table, rejected = add(spark, three(spark), ("https://n", "x" * 256, None), ("https://n", "fine", None), ("https://n", "late", None))
    assert rejected == {0: "name_too_long", 2: "conflict"}
    assert [r.name for r in table.where("url = 'https://n'").collect()] == ["fine"]


def test_status(spark):
    table = three(spark)
    wanted = spark.createDataFrame(
        [(0, fid(1), False), (1, fid(3), False), (2, fid(3), True), (3, fid(9), True), (4, "junk", True)],
        "request_no int, id string, is_active boolean",
    )
    change = registry.set_status(table, wanted, now())
    assert {r.id: (r.is_active, str(r.updated_at)) for r in change.table.collect()} == {
        fid(1): (False, NOW), fid(2): (True, str(at(1))), fid(3): (True, NOW),
    }
    assert {r.id for r in change.rejected.collect()} == {fid(9), "junk"}


def test_flips_cancel_out(spark):
    flips = spark.createDataFrame([(fid(1),), (fid(2),), (fid(2),), ("{" + fid(3) + "}",), ("nope",)], "id string")
    change = registry.flip_status(three(spark), flips, now())
    assert {r.id: r.is_active for r in change.table.collect()} == {fid(1): False, fid(2): True, fid(3): True}
    assert [(r.id, r.reason) for r in change.rejected.collect()] == [("nope", "not_found")]


def test_delete_cascades(spark):
    stored = articles(spark, (10, 1, "u10", 5, at()), (11, 2, "u11", 5, at()), (12, 1, "u12", 5, at()))
    kept = vectors(spark, (10, [1], at()), (11, [1], at()), (77, [1], at()))
    gone = spark.createDataFrame([(fid(1),), (fid(1),), ("non-existent-id",)], "id string")
    left = registry.delete_feeds(three(spark), stored, kept, gone)
    assert {r.id for r in left.feeds.collect()} == {fid(2), fid(3)}
    assert {r.id for r in left.articles.collect()} == {fid(11)}
    assert {r.article_id for r in left.embeddings.collect()} == {fid(11), fid(77)}
    assert [r.id for r in left.rejected.collect()] == ["non-existent-id"]
    assert left.articles.columns == stored.columns
