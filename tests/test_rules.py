import pytest
from pyspark.sql import functions as F

from feedloom.functions import rules


def test_feed_error(spark):
    cases = [
        ("https://feeds.example.org/all/", "Example", None),
        ("  HTTPS://feeds.example.org/all/ ", "x", None),
        ("not-a-valid-url", "Invalid Feed", "invalid_url"),
        ("https://example.com/rss", "   ", "empty_name"),
        ("not-a-valid-url", " ", "empty_name"),  # the name is checked first
        ("ftp://example.com", "x", "invalid_url"),
        ("/only/a/path", "x", "invalid_url"),
        ("http://a b/", "x", "invalid_url"),
        ("http://host:port/", "x", "invalid_url"),
        ("http://host:80/a b?x=%zz", "x", None),
        ("http://host/%zz", "x", "invalid_url"),
        ("http://host/a\tb", "x", "invalid_url"),
        ("http://[::1]:80/", "x", None),
        ("http://user:pw@host/", "x", None),
        ("http:opaque", "x", None),
        ("https://h/" + "a" * 2038, "x", None),
        ("https://h/" + "a" * 2039, "x", "url_too_long"),
        ("https://h/", "é" * 255, None),
        ("https://h/", "é" * 256, "name_too_long"),
    ]
    rows = spark.createDataFrame([(i, u, n) for i, (u, n, _) in enumerate(cases)], "i int, u string, n string")
    got = [r.e for r in rows.select("i", rules.feed_error(F.col("u"), F.col("n")).alias("e")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_article_error_order(spark):
    cases = [
        ("t", "u", 1, None), ("t", "u", 10, None), (" ", "", 0, "empty_title"), ("t", " ", 0, "empty_url"),
        ("t", "u", 0, "invalid_score"), ("t", "u", 11, "invalid_score"), ("t", "u", None, "invalid_score"),
        ("x" * 1025, "u", 5, "title_too_long"), ("x" * 1024, "u", 5, None), (None, "u", 5, "empty_title"),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, u string, s int")
    got = [r.e for r in rows.select("i", rules.article_error(F.col("t"), F.col("u"), F.col("s")).alias("e")).orderBy("i").collect()]
    assert got == [c[3] for c in cases]


def test_scores_and_limits(evaluate):
    assert evaluate(rules.clamp_score, [-3, 0, 1, 8, 10, 99, None], "int") == [1, 1, 1, 8, 10, 10, 1]
    asked = [None, -2, 0, 1, 5, 50, 51]
    assert evaluate(rules.hit_limit_column, asked, "int") == [5, 5, 5, 1, 5, 50, 50]
    assert [rules.hit_limit(k) for k in [*asked, "abc", "7", ""]] == [5, 5, 5, 1, 5, 50, 50, 5, 7, 5]
    texts = ["+7", "-7", " 7", "7 ", "1_0", "7\n", "٣", "9223372036854775807", "9223372036854775808", "", None, "0", "51"]
    want = [7, 5, 5, 5, 5, 5, 5, 50, 5, 5, 5, 5, 50]
    assert [rules.hit_limit(k) for k in texts] == want and rules.hit_limit(True) == 5 and rules.hit_limit(7.0) == 5
    assert evaluate(rules.hit_limit_of_text, texts) == want


def test_queries_and_names(evaluate):
    assert rules.clean_query("  stream joins ") == "stream joins"
    with pytest.raises(ValueError):
        rules.clean_query("   ")
    assert evaluate(rules.query_error, ["x", "   ", None]) == [None, "empty_query", "empty_query"]
    name = rules.feed_name
    assert evaluate(lambda c: name(F.lit(" Given "), c, F.lit("u")), ["Found"]) == ["Given"]
    assert evaluate(lambda c: name(F.lit(" "), c, F.lit("u")), [" Found ", "", None, "  "]) == ["Found", "u", "u", ""]
