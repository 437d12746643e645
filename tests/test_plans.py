"""What the plans have to look like, and how hot keys are spread."""

import pytest
from pyspark.sql import functions as F

from feedloom.operators import embeddings, enrich, ingest, joins, ranking, registry, search
from feedloom.plans import daily_run, sample_tables
from feedloom.plans.queries import registered
from feedloom.sources import documents
from tests.tables import articles, at, feeds, fid, vectors

FOLDER = "/root/testdata/sf0.001"
STARTS_JOBS = {n for n in registered() if n.startswith(("daily_", "stream_"))}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark, monkeypatch):
    """Joins as on tables too large to broadcast, partitions as planned."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "ROWS_PER_TASK", 250)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for key, value in saved.items():
        spark.conf.set(key, value)


@pytest.fixture
def on_disk(spark, tmp_path):
    table = articles(spark, *[(i, 1, f"u{i}", 1 + i % 10, at(1 + i % 5)) for i in range(40)])
    table.write.parquet(str(tmp_path / "articles"))
    return spark.read.parquet(str(tmp_path / "articles"))


@pytest.mark.parametrize("name", sorted(set(registered()) - STARTS_JOBS))
def test_no_query_joins_everything_with_everything(spark, name):
    text = plan(registered()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_of_day_pushes_the_day_and_keeps_n_rows_per_task(on_disk):
    text = plan(ranking.top_of_day(on_disk, F.lit("2024-01-02 12:00:00").cast("timestamp"), 5))
    assert "TakeOrderedAndProject" in text and "GreaterThanOrEqual(created_at" in text


def test_top_per_day_limits_before_the_shuffle(on_disk):
    text = plan(ranking.top_per_day(on_disk, 3))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_search_moves_ids_and_fetches_by_pushed_ids(spark, on_disk):
    stored = vectors(spark, *[(i, [1.0, i], at()) for i in range(40)])
    text = plan(search.search(on_disk, stored, [1.0, 2.0], 20))
    assert "In(id, [" in text and "created_at" in text.split("PushedFilters")[1] and "Join" not in text
    near = plan(search.nearest(stored, [1.0, 2.0], 20, on_disk))
    assert "TakeOrderedAndProject" in near
    assert "embedding" not in near[: near.index("MapInArrow")]


def test_batch_search_limits_before_the_shuffle(spark):
    stored = vectors(spark, *[(i, [1.0, i], at()) for i in range(40)])
    asked = spark.createDataFrame([(0, [1.0, 0.0], 3)], "query_id int, embedding array<float>, requested int")
    text = plan(search.batch_search(stored, asked, 2))
    assert "WindowGroupLimit" in text and text.count("Exchange") == 1


def test_active_feeds_and_lookups_are_pushed(spark, tmp_path):
    feeds(spark, (1, "https://a", "a", True)).write.parquet(str(tmp_path / "feeds"))
    table = spark.read.parquet(str(tmp_path / "feeds"))
    assert "EqualTo(is_active,true)" in plan(registry.active_feeds(table))
    assert f"EqualTo(id,{fid(1)})" in plan(registry.find_by_id(table, fid(1)))
    assert "EqualTo(url,https://a)" in plan(registry.find_feed_by_url(table, "https://a"))


def test_offline_enrichment_needs_no_python(spark):
    items = spark.createDataFrame([(fid(1), "t", "u", "c", None)], "feed_id string, title string, url string, content string, published_at timestamp")
    provider = enrich.OfflineProvider()
    valid, _ = enrich.enrich_items(items, provider, F.current_timestamp())
    made, _ = enrich.embed_articles(valid, provider, F.current_timestamp())
    assert "Python" not in plan(made) and "MapIn" not in plan(made)


def test_a_body_is_parsed_once(spark):
    raw = sample_tables.raw_feeds(sample_tables.read(spark, FOLDER, "documents"))
    for frame in (ingest.normalise_items(documents.entries(raw)), documents.feed_titles(raw), documents.unreadable(raw)):
        # the second parse is for bodies that the first one rejects
        assert plan(frame).count("from_xml(") == 2


def test_no_text_moves_before_the_existence_check(shuffled):
    items = sample_tables.items(shuffled, FOLDER)
    known = articles(shuffled, (1, 1, "u", 5, at()))
    places = ingest.unseen(ingest.first_places(items), known)
    for line in plan(places).splitlines():
        assert not (("Sort" in line or "Exchange" in line) and "content" in line), line
    assert "content" not in places.columns and "content" in ingest.at_places(items, places).columns


def test_the_run_stages_places_and_no_texts(spark):
    raw = sample_tables.raw_feeds(sample_tables.read(spark, FOLDER, "documents"))
    bodies = daily_run.wanted_bodies(raw, sample_tables.feeds(spark, FOLDER))
    assert set(daily_run.listed(bodies).columns) == {"feed_id", "feed_name", "fetched_at", "body_key", "item_pos", "url", "reason"}


def test_rankings_of_every_day_move_no_texts(on_disk):
    text = plan(ranking.top_per_day(on_disk, 3))
    below = text[text.index("Window") :]
    assert "quality_score" in below and "raw_content" not in below and "summary" not in below


def test_few_keys_leave_the_wide_side_in_place(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = sample_tables.items(spark, FOLDER)
        known = sample_tables.feeds(spark, FOLDER)
        text = plan(ingest.of_known_feeds(rows, known))
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        stored = sample_tables.embeddings(spark, FOLDER)
        text = plan(embeddings.upsert_embeddings(stored, stored, 64)[0])
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
        found = ingest.first_places(rows)
        text = plan(ingest.unseen_staged(found, articles(spark, (1, 1, "u", 5, at()))))
        assert text.count("BroadcastHashJoin") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_fallback_reads_narrow_then_fetches_by_id_and_time(on_disk):
    text = plan(ranking.top_or_latest(on_disk, F.lit("2030-01-01").cast("timestamp"), 3))
    assert "In(id, [" in text and "created_at" in text.split("PushedFilters")[1]


def test_a_table_by_day_is_pruned(spark, tmp_path):
    rows = articles(spark, *[(i, 1, f"u{i}", 1 + i % 10, at(1 + i % 5, i % 24)) for i in range(40)])
    ingest.write_articles(rows, str(tmp_path / "articles"))
    table = spark.read.parquet(str(tmp_path / "articles"))
    noon = F.lit("2024-01-02 12:00:00").cast("timestamp")
    day = ranking.top_of_day(table, noon, 3)
    assert "PartitionFilters: [isnotnull(day" in plan(day) and "2024-01-02" in plan(day)
    assert [r.id for r in day.collect()] == [r.id for r in ranking.top_of_day(rows, noon, 3).collect()]
    late = F.lit("2030-01-01").cast("timestamp")
    latest = ranking.top_or_latest(table, late, 3)
    assert "PartitionFilters: [" in plan(latest) and "day" in plan(latest).split("PartitionFilters: [")[1][:60]
    assert [r.id for r in latest.collect()] == [r.id for r in ranking.top_or_latest(rows, late, 3).collect()]


def shares(frame):
    """Share of all rows in each partition, largest first."""
    sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
    return sorted((s / sum(sizes) for s in sizes), reverse=True)


def test_a_hot_feed_is_spread_over_tasks(shuffled):
    spark = shuffled
    rows = spark.range(6000).select(
        F.when(F.col("id") < 4000, fid(1)).otherwise(F.concat(F.lit("other-"), F.col("id") % 50)).alias("feed_id"),
        F.concat(F.lit("u"), F.col("id")).alias("url"),
        F.col("id").alias("item_pos"),
    )
    known = feeds(spark, (1, "https://a", "a", True))
    ids = known.select(F.col("id").alias("feed_id"))
    kept = ingest.of_known_feeds(rows, known)
    assert "SortMergeJoin" in plan(kept)
    assert kept.count() == 4000 and ingest.of_unknown_feeds(rows, known).count() == 2000
    assert shares(kept)[0] < 0.35
    assert shares(rows.join(ids, "feed_id", "left_semi"))[0] == 1  # what it would be without the salt


def test_copies_of_one_hot_feed_are_spread_too(shuffled):
    spark = shuffled
    rows = spark.range(4000).select(F.lit(fid(1)).alias("feed_id"), F.lit("same").alias("url"), F.col("id").alias("item_pos"))
    kept = ingest.of_known_feeds(rows, feeds(spark, (1, "https://a", "a", True)))
    assert kept.count() == 4000 and shares(kept)[0] < 0.35


def test_cascade_spreads_a_hot_feed(shuffled):
    spark = shuffled
    table = articles(spark, *[(i, 1 if i < 1500 else 2, f"u{i}", 5, at()) for i in range(2000)])
    known = feeds(spark, (1, "https://a", "a", True), (2, "https://b", "b", True))
    gone = spark.createDataFrame([(fid(2),)], "id string")
    left = registry.delete_feeds(known, table, vectors(spark, (1999, [1], at())), gone)
    assert left.articles.count() == 1500 and left.embeddings.isEmpty()
    assert shares(left.articles)[0] < 0.35


def test_requests_for_one_url_are_spread(shuffled):
    spark = shuffled
    requests = spark.range(3000).select(
        F.col("id").alias("request_no"), F.lit("https://hot").alias("url"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("discovered")
    )
    change = registry.add_feeds(feeds(spark, (1, "https://a", "a", True)), requests, F.current_timestamp())
    assert change.table.count() == 2 and change.rejected.count() == 2999
    assert shares(change.rejected)[0] < 0.35
