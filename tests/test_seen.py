import datetime

from pyspark.sql import functions as F

from feedloom.operators import enrich, ingest, seen
from feedloom.plans import daily_run
from feedloom.streaming import ingest_stream
from tests.tables import articles, at, feeds, raw, rss


def history(spark, path, days=9, per_day=400):
    """Articles of some days, written in two runs, with their filters."""
    for part in (0, 1):
        rows = [(1000 * d + i, 1, f"https://ex/{d}/{i}", 5, at(1 + d, i % 24)) for d in range(days) for i in range(part, per_day, 2)]
        ingest.write_articles(articles(spark, *rows), f"{path}/articles")
        new = daily_run.read_articles(spark, f"{path}/articles").where(F.expr(f"cast(substring_index(url, '/', -1) as int) % 2 = {part}"))
        seen.write_filters(new, f"{path}/filters")
    return daily_run.read_articles(spark, f"{path}/articles"), spark.read.parquet(f"{path}/filters")


def urls(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "url string, place int")


def test_no_stored_url_is_missed_and_few_days_are_read(spark, tmp_path):
    stored, filters = history(spark, tmp_path)
    for day in (0, 4, 8):
        asked = urls(spark, *[f"https://ex/{day}/{i}" for i in range(400)])
        assert seen.named_parts(asked, filters) == [datetime.date(2024, 1, 1 + day)]
    fresh = urls(spark, *[f"https://new/{i}" for i in range(2000)])
    named = seen.parts_with(fresh, filters).count()
    assert named <= 4  # 2,000 urls and 9 days: one wrong name in some 40,000 look-ups


def test_unseen_is_exact(spark, tmp_path):
    stored, filters = history(spark, tmp_path)
    asked = urls(spark, "https://ex/3/7", "https://ex/3/400", "https://new/a", "https://new/a", "https://ex/8/0")
    asked.write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked"))
    left = seen.unseen_by_filters(asked, stored, filters)
    want = ingest.unseen(asked, stored)
    assert left.columns == asked.columns and sorted(left.collect()) == sorted(want.collect()) and left.count() == 3


def test_only_named_days_are_scanned(spark, tmp_path):
    stored, filters = history(spark, tmp_path)
    asked = urls(spark, "https://ex/3/7", "https://other")
    plan = seen.unseen_by_filters(asked, stored, filters)._jdf.queryExecution().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet [url" in line)
    assert "PartitionFilters: [" in scan and "2024-01-04" in scan and "2024-01-05" not in scan


def test_empty_sides(spark, tmp_path):
    stored, filters = history(spark, tmp_path, days=1, per_day=4)
    assert seen.unseen_by_filters(urls(spark), stored, filters).count() == 0
    asked = urls(spark, "https://ex/0/1")
    assert seen.unseen_by_filters(asked, stored.limit(0), filters.limit(0)).count() == 1


def test_filters_are_small_and_merge(spark, tmp_path):
    _, filters = history(spark, tmp_path, days=1, per_day=4000)
    sizes = filters.select("words").distinct().collect()
    assert [r.words for r in sizes] == [1024]  # of 2,000 urls in each run
    assert filters.count() <= 2 * 1024


def test_a_backfill_reads_everything(spark, tmp_path, monkeypatch):
    stored, filters = history(spark, tmp_path, days=2, per_day=10)
    monkeypatch.setattr(seen, "few", lambda rows: False)
    asked = urls(spark, "https://ex/0/1", "https://new")
    assert [r.url for r in seen.unseen_by_filters(asked, stored, filters).collect()] == ["https://new"]


FEEDS = ((1, "https://a", "alpha", True),)


def batch(spark, *titles, minute=0):
    return raw(spark, (1, minute, rss(*[(t, f"https://{t}", "words") for t in titles])))


def run_batch(spark, out, base, number, *titles, filters=None, provider=None):
    store = ingest_stream.store_batch(
        feeds(spark, *FEEDS), base, provider or enrich.OfflineProvider(), F.lit("2024-01-03 06:00:00").cast("timestamp"), out, 8, filters
    )
    store(batch(spark, *titles), number)


def stored_by(spark, out):
    rows = ingest_stream.written(spark, out).select("batch_id", "url").collect()
    return sorted((r.batch_id, r.url.removeprefix("https://")) for r in rows)


def test_batches_know_all_earlier_ones(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest_stream, "SEALED", 2)
    out, base = str(tmp_path), articles(spark, (1, 1, "https://old", 5, at()))
    run_batch(spark, out, base, 0, "a", "old", "b")
    run_batch(spark, out, base, 1, "b", "c")
    run_batch(spark, out, base, 2, "a", "c", "d")
    run_batch(spark, out, base, 3)
    run_batch(spark, out, base, 4, "a", "d", "e")
    want = [(0, "a"), (0, "b"), (1, "c"), (2, "d"), (4, "e")]
    assert stored_by(spark, out) == want
    # tried again after a failure: the same, merged filters too
    run_batch(spark, out, base, 4, "a", "d", "e")
    assert stored_by(spark, out) == want


def test_a_batch_reads_no_more_as_batches_add_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest_stream, "SEALED", 4)
    out, base = str(tmp_path), articles(spark, (1, 1, "https://old", 5, at()))
    reads = []
    original = ingest_stream._read

    def noted(session, folder, table, schema, batches):
        reads.append((table, tuple(batches)))
        return original(session, folder, table, schema, batches)

    monkeypatch.setattr(ingest_stream, "_read", noted)
    for number in range(6):
        run_batch(spark, out, base, number, f"n{number}", "n0")
    assert stored_by(spark, out) == [(n, f"n{n}") for n in range(6)]
    last = reads[-2:]
    assert last == [("filters", (4,)), ("articles", (0,))]


def test_base_with_filters(spark, tmp_path):
    base, filters = history(spark, tmp_path / "base", days=2, per_day=6)
    out = str(tmp_path / "out")
    store = lambda n, *t: run_batch(spark, out, base, n, *t, filters=filters)
    store(0, "ex/0/1", "x", "ex/1/99")
    store(1, "x", "ex/1/5", "y")
    assert stored_by(spark, out) == [(0, "ex/1/99"), (0, "x"), (1, "y")]


def test_a_run_with_filters_leaves_its_own(spark, tmp_path):
    base, filters = history(spark, tmp_path / "base", days=2, per_day=6)
    result = daily_run.run_daily(
        feeds(spark, *FEEDS), base, batch(spark, "ex/0/1", "x"), enrich.OfflineProvider(),
        F.lit("2024-01-03 06:00:00").cast("timestamp"), str(tmp_path / "out"), filters=filters,
    )
    assert [r.url for r in result.articles.collect()] == ["https://x"] and (result.items_checked, result.new_articles) == (2, 1)
    own = spark.read.parquet(str(tmp_path / "out" / "filters"))
    assert seen.named_parts(result.articles.select("url"), own) == [datetime.date(2024, 1, 3)]


def test_small_days_are_few_files_and_a_look_up_meets_few_of_them(spark, tmp_path, monkeypatch):
    rows = [(i, 1, f"https://ex/{i}", 5, at() + datetime.timedelta(i // 4)) for i in range(4 * 300)]
    rows = articles(spark, *rows)
    ingest.write_articles(rows, str(tmp_path / "articles"), folders=False)
    stored = daily_run.read_articles(spark, str(tmp_path / "articles"))
    seen.write_filters(stored, str(tmp_path / "filters"))
    assert len(list(tmp_path.glob("articles/**/*.parquet"))) + len(list(tmp_path.glob("filters/**/*.parquet"))) < 40  # of 300 days
    filters = spark.read.parquet(str(tmp_path / "filters"))
    met = filters.groupBy("words", "word").count().agg(F.max("count")).first()[0]
    assert filters.count() <= 2 * 1200 and met < 10  # days that a look-up meets at one word
    asked = urls(spark, *[f"https://ex/{i}" for i in range(0, 1300, 2)])
    asked.write.parquet(str(tmp_path / "asked"))
    asked = spark.read.parquet(str(tmp_path / "asked"))
    want = sorted(r.url for r in ingest.unseen(asked, stored).collect())
    assert len(want) == 50
    for listed in (1000, 3):
        monkeypatch.setattr(seen, "LISTED", listed)
        assert sorted(r.url for r in seen.unseen_by_filters(asked, stored, filters).collect()) == want
