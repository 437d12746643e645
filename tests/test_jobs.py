"""Ranking, the daily run and the stream."""

import datetime
import json
import uuid

from pyspark.sql import functions as F

from feedloom import schemas as S
from feedloom import session
from feedloom.operators import enrich, ingest, ranking
from feedloom.operators.enrich import OfflineProvider
from feedloom.plans import daily_run
from feedloom.streaming import ingest_stream
from tests.tables import articles, at, feeds, fid, raw, rss, vectors


def when(text):
    return F.lit(text).cast("timestamp")


def stored(spark):
    return articles(
        spark,
        (1, 1, "u1", 9, at(1, 5)), (2, 1, "u2", 7, at(2, 1)), (3, 1, "u3", 7, at(2, 3)),
        (4, 1, "u4", 8, at(2, 0)), (5, 1, "u5", 7, at(2, 3)), (6, 1, "u6", 10, at(2, 20)),
    )


def ids(frame):
    return [int(r.id[-3:]) for r in frame.collect()]


def test_top_of_day(spark):
    table = stored(spark)
    assert ids(ranking.top_of_day(table, when("2024-01-02 12:00:00"), 3)) == [4, 3, 5]
    assert ids(ranking.top_of_day(table, when("2024-01-02 23:00:00"), 0)) == [6, 4, 3, 5, 2]
    assert ids(ranking.top_of_day(table, when("2024-01-03 12:00:00"), 3)) == []


def test_fallback_only_without_any_article_of_the_day(spark):
    table = stored(spark)
    assert ids(ranking.top_or_latest(table, when("2024-01-03 12:00:00"), 2)) == [6, 1]
    assert sorted(ids(ranking.top_or_latest(table, when("2024-01-02 12:00:00"), 50))) == [2, 3, 4, 5]
    assert ids(ranking.top_or_latest(table.limit(0), when("2024-01-02 12:00:00"), 5)) == []


def test_top_per_day(spark):
    rows = ranking.top_per_day(stored(spark), 2).orderBy("day", "rank").collect()
    assert [(r.day.day, r["rank"], int(r.id[-3:])) for r in rows] == [(1, 1, 1), (2, 1, 6), (2, 2, 4)]


def kept_by_runs(spark, path, *runs, n=ranking.KEPT):
    for rows in runs:
        table = articles(spark, *rows)
        ingest.write_articles(table, f"{path}/articles")
        ranking.keep_ranking(table, f"{path}/kept", n)
    return daily_run.read_articles(spark, f"{path}/articles"), spark.read.parquet(f"{path}/kept")


def test_kept_ranking(spark, tmp_path):
    first = [(i, 1, f"u{i}", 1 + i % 10, at(2, i % 6)) for i in range(200)]
    second = [(500 + i, 1, f"v{i}", 1 + i % 10, at(2, 6 + i % 3)) for i in range(90)] + [(700, 1, "w", 10, at(4, 1))]
    table, kept = kept_by_runs(spark, tmp_path, first, second)
    assert kept.count() == 50 + 50 + 1
    for day, n in (("2024-01-02 12:00:00", 5), ("2024-01-02 12:00:00", 50), ("2024-01-04 12:00:00", 7), ("2024-01-05 12:00:00", 30)):
        assert ids(ranking.top_from_kept(table, kept, when(day), n)) == ids(ranking.top_or_latest(table, when(day), n))


def test_kept_ranking_reads_no_articles_but_the_best(spark, tmp_path, monkeypatch):
    table, kept = kept_by_runs(spark, tmp_path, [(i, 1, f"u{i}", 1 + i % 10, at(2, i % 6)) for i in range(60)])
    monkeypatch.setattr(ranking, "top_or_latest", None)  # would be called for a scan
    found = ranking.top_from_kept(table, kept, when("2024-01-05 00:00:00"), 3)
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and len(ids(found)) == 3
    assert ranking.top_from_kept(table.limit(0), kept.limit(0), when("2024-01-05 00:00:00"), 3).count() == 0


def test_kept_ranking_of_the_past_or_of_too_many(spark, tmp_path):
    rows = [(i, 1, f"u{i}", 5 if i < 10 else 9, at(2, i % 20)) for i in range(100)]
    table, kept = kept_by_runs(spark, tmp_path, rows, n=5)
    for day, n in (("2024-01-02 00:30:00", 5), ("2024-01-02 23:00:00", 20), ("2024-01-03 23:00:00", 20)):
        assert ids(ranking.top_from_kept(table, kept, when(day), n)) == ids(ranking.top_or_latest(table, when(day), n))


FEEDS = ((1, "https://a", "zeta", True), (2, "https://b", "alpha", True), (3, "https://c", "off", False))
BODIES = (
    (1, 1, rss(("Zeta shared", "https://shared", "z"), ("Zeta own", "https://own", "z"), ("old", "u1", "z"))),
    (2, 1, rss(("", "https://untitled", "a"), ("Alpha shared", "https://shared", "a"))),
    (3, 1, rss(("Inactive", "https://inactive", "i"))),
    (2, 2, "<rss><channel>broken"),
)
AS_OF = "2024-01-03 06:00:00"


def run(spark, out, feed_rows=FEEDS, bodies=BODIES, table=None, top_n=5, send=None):
    table = stored(spark) if table is None else table
    return daily_run.run_daily(
        feeds(spark, *feed_rows), table, raw(spark, *bodies), OfflineProvider(), when(AS_OF), str(out), top_n, send=send
    )


def test_daily_run(spark, tmp_path):
    result = run(spark, tmp_path)
    assert {(r.url, r.title, r.feed_id) for r in result.articles.collect()} == {
        ("https://shared", "Alpha shared", fid(2)),  # feeds are taken by name
        ("https://own", "Zeta own", fid(1)),
    }
    assert {r.article_id for r in result.embeddings.collect()} == {r.id for r in result.articles.collect()}
    assert (result.items_checked, result.new_articles) == (5, 2)
    (chunk,) = result.chunks.collect()
    assert chunk.digest_date == datetime.date(2024, 1, 3) and "Alpha shared" in chunk.body and "#2" in chunk.body


def test_failed_rows_are_kept_and_no_answer_is_asked_for_twice(spark, tmp_path):
    calls = tmp_path / "calls"

    def answer(client, prompt):
        with open(calls, "a") as file:
            file.write("x")
        if "Zeta own" in prompt:
            raise TimeoutError("quota")
        return json.dumps({"three_line_summary": "s", "key_takeaways": [], "quality_score": 3})

    model = enrich.Model(lambda: None, enrich.one_by_one(answer), lambda client, texts: [[1.0, 2.0, 3.0] for _ in texts])
    result = daily_run.run_daily(
        feeds(spark, *FEEDS), stored(spark), raw(spark, *BODIES), enrich.ModelProvider((model,)), when(AS_OF), str(tmp_path / "out"), dim=4
    )
    found = {(r.stage, r.feed_id, r.url, r.reason) for r in result.rejected.collect()}
    assert found == {
        ("parse", fid(2), None, "unreadable"),
        ("check", fid(2), "https://untitled", "empty_title"),
        ("enrich", fid(1), "https://own", "TimeoutError: quota"),
        ("embed", fid(2), "https://shared", "wrong_dimension"),
    }
    assert result.embeddings.isEmpty() and result.articles.count() == 1
    assert calls.read_text() == "xx"


def test_a_body_fetched_twice_gives_its_items_once(spark, tmp_path):
    result = run(spark, tmp_path, bodies=[BODIES[0], BODIES[0]])
    assert sorted(r.url for r in result.articles.collect()) == ["https://own", "https://shared"]


def test_a_failure_to_send_does_not_lose_the_digest(spark, tmp_path, caplog):
    sent = []

    def fail(chunks):
        sent.append(chunks.count())
        raise ConnectionError("no network")

    result = run(spark, tmp_path, send=fail)
    assert sent == [1] and result.chunks.count() == 1 and "no network" in caplog.text


def test_nothing_new_still_ranks_and_falls_back(spark, tmp_path):
    result = run(spark, tmp_path, bodies=[(1, 1, rss(("old", "u1", "z")))], top_n=2)
    assert result.articles.isEmpty()
    assert ids(result.top) == [6, 1]
    assert result.chunks.count() == 1


def test_without_active_feeds_nothing_happens(spark, tmp_path):
    result = run(spark, tmp_path, feed_rows=[(1, "https://a", "zeta", False)])
    assert result.articles.isEmpty() and result.embeddings.isEmpty() and result.top.isEmpty() and result.chunks.isEmpty()


def test_without_any_article_nothing_is_sent(spark, tmp_path):
    sent = []
    result = run(spark, tmp_path, bodies=[(1, 1, "junk")], table=stored(spark).limit(0), send=sent.append)
    assert result.chunks.isEmpty() and sent == []


def start(spark, source, out, table):
    arriving = spark.readStream.schema(S.RAW_FEEDS).option("maxFilesPerTrigger", 1).parquet(str(source))
    ingest_stream.ingest_available(
        arriving, feeds(spark, *FEEDS), table, OfflineProvider(), when(AS_OF), str(out), f"{out}/checkpoint"
    ).awaitTermination()
    return {r.url for r in ingest_stream.written(spark, str(out)).select("url").collect()}


def test_stream_adds_only_unseen_urls(spark, tmp_path):
    source, out, table = tmp_path / "in", tmp_path / "out", stored(spark)
    raw(spark, *BODIES).coalesce(1).write.parquet(str(source))
    assert start(spark, source, out, table) == {"https://shared", "https://own"}
    assert start(spark, source, out, table) == {"https://shared", "https://own"}  # nothing arrived

    more = [(1, 3, rss(("again", "https://own", "z"), ("Late", "https://late", "z")))]
    raw(spark, *more).coalesce(1).write.mode("append").parquet(str(source))
    assert start(spark, source, out, table) == {"https://shared", "https://own", "https://late"}
    written = ingest_stream.written(spark, str(out))
    assert written.count() == 3 and {r.batch_id for r in written.collect()} == {0, 1}


def test_a_batch_tried_again_writes_the_same(spark, tmp_path):
    out, table = str(tmp_path / "out"), stored(spark)
    store = ingest_stream.store_batch(feeds(spark, *FEEDS), table, OfflineProvider(), when(AS_OF), out)

    def all_written():
        names = ("articles", "embeddings", "rejected")
        return {t: sorted(map(tuple, ingest_stream.written(spark, out, t).collect()), key=str) for t in names}

    store(raw(spark, *BODIES), 0)
    second = raw(spark, (1, 3, rss(("again", "https://own", "z"), ("Late", "https://late", "z"))))
    store(second, 1)
    before = all_written()
    store(second, 1)
    store(raw(spark, *BODIES), 0)
    assert all_written() == before
    assert {t: len(rows) for t, rows in before.items()} == {"articles": 3, "embeddings": 3, "rejected": 2}
    assert {r[0] for r in before["embeddings"]} == {r[0] for r in before["articles"]}


def test_a_kept_ranking_of_many_days_is_few_files(spark, tmp_path):
    rows = articles(spark, *[(i, 1, f"u{i}", 1 + i % 10, at() + datetime.timedelta(i)) for i in range(300)])
    ranking.keep_ranking(rows, str(tmp_path / "kept"))
    assert len(list(tmp_path.glob("kept/**/*.parquet"))) < 40
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 300


def test_arriving_files_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch):
    from feedloom.plans import queries

    found = {}
    for size in (64 << 20, 100_000):
        out = str(tmp_path / str(size))
        monkeypatch.setattr(queries, "_ARRIVING", size)
        monkeypatch.setattr(session, "shared_folder", lambda spark, purpose: f"{out}/{purpose}-{uuid.uuid4().hex}")
        found[size] = sorted(tuple(r) for r in queries.registered()["stream_ingest"](spark, "/root/testdata/sf0.001").collect())
        files = list((tmp_path / str(size)).glob("stream-*/arriving/*.parquet"))
        assert len(files) == 3 if size > 100_000 else len(files) > 3
        assert len(list((tmp_path / str(size)).glob("stream-*/articles/batch_id=*"))) == 3
    assert len(set(map(tuple, found.values()))) == 1 and found[100_000]
