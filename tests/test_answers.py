import uuid

from pyspark.sql import functions as F

from feedloom.operators import answers, enrich

ITEMS = "url string, title string, content string"


class Counting:
    """Counts what it is asked for, and fails on some titles."""

    def __init__(self, failing=()):
        self.asked, self.failing = [], list(failing)

    def summarise(self, items):
        self.asked += [r.title for r in items.collect()]
        made = enrich.OfflineProvider().summarise(items)
        return made.withColumn("error", F.when(F.col("title").isin(self.failing), "quota"))

    def embed(self, texts):
        self.asked += [r.text for r in texts.collect()]
        return enrich.OfflineProvider().embed(texts)


def store(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def items(spark, *titles):
    return spark.createDataFrame([(f"https://{i}", t, None if t is None else f"on {t}") for i, t in enumerate(titles)], ITEMS)


def test_an_input_is_asked_for_once_across_rows_and_runs(spark, tmp_path):
    path, first, second = store(tmp_path), Counting(), Counting()
    rows = items(spark, "a", "b", None, "b").unionByName(items(spark, "a"))
    got = answers.KeptProvider(first, path).summarise(rows)
    assert got.count() == 5 and got.where("error IS NULL").count() == 5
    twice = [("https://0", "a", "on a"), ("https://1", "b", "on b"), ("https://2", "b", "other")]
    twice = spark.createDataFrame(twice, ITEMS)
    found = answers.KeptProvider(second, path).summarise(twice).orderBy("url").collect()
    assert sorted(first.asked, key=str) == [None, "a", "b"]
    assert second.asked == ["b"]
    plain = enrich.OfflineProvider().summarise(twice).orderBy("url").collect()
    assert [r.asDict() for r in found] == [r.asDict() for r in plain]


def test_what_failed_is_asked_again(spark, tmp_path):
    path, bad, good = store(tmp_path), Counting(["b"]), Counting()
    rows = items(spark, "a", "b")
    assert [r.error for r in answers.KeptProvider(bad, path).summarise(rows).orderBy("url").collect()] == [None, "quota"]
    assert [r.error for r in answers.KeptProvider(good, path).summarise(rows).orderBy("url").collect()] == [None, None]
    assert good.asked == ["b"]


def test_another_version_asks_anew(spark, tmp_path):
    path, one, two = store(tmp_path), Counting(), Counting()
    answers.KeptProvider(one, path, "m1").summarise(items(spark, "a"))
    answers.KeptProvider(two, path, "m2").summarise(items(spark, "a"))
    assert one.asked == two.asked == ["a"]


def test_vectors_are_kept_and_empty_tables_ask_nothing(spark, tmp_path):
    path, first, second = store(tmp_path), Counting(), Counting()
    texts = spark.createDataFrame([("x", "t"), ("y", "t"), ("z", None)], "article_id string, text string")
    assert answers.KeptProvider(first, path).embed(texts.limit(0)).count() == 0
    made = answers.KeptProvider(first, path).embed(texts)
    again = answers.KeptProvider(second, path).embed(texts)
    assert sorted(map(str, made.collect())) == sorted(map(str, again.collect()))
    assert len(first.asked) == 2 and second.asked == []
