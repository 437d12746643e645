"""The registered queries: each operator over the whole given tables.

Timestamps are given as text and doubles at six decimals, so that results can be
compared between engines.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom import session
from feedloom.functions import rules, text, vectors
from feedloom.operators import ann, answers, constraints, digest, embeddings, enrich, graph, ingest, keyed, ranking, registry, search, seen
from feedloom.plans import daily_run as daily
from feedloom.plans import sample_tables as tables
from feedloom.sources import documents as feed_documents
from feedloom.streaming import ingest_stream

Query = Callable[[SparkSession, str], DataFrame]

_REGISTERED: dict[str, Query] = {}


def _as_of() -> Column:
    return F.lit("2024-01-02 12:00:00").cast("timestamp")


def _later() -> Column:
    return F.lit("2030-01-01 00:00:00").cast("timestamp")


def query(build: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return build(session.prepare(spark), folder)

    _REGISTERED[build.__name__] = run
    return run


def registered() -> dict[str, Query]:
    return dict(_REGISTERED)


def _stamp(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _six(value: Column) -> Column:
    return F.round(value, 6)


# similarity search


def _first_vector(spark: SparkSession, folder: str) -> list[float]:
    return tables.embeddings(spark, folder).where("vec_id = 0").first()["embedding"]


@query
def knn_top5(spark, folder):
    hits = search.search(
        tables.articles(spark, folder), tables.embeddings(spark, folder), _first_vector(spark, folder), 5
    )
    return hits.select(
        "id", "feed_id", "title", "url", "summary", "quality_score", _stamp("published_at"), _stamp("created_at"),
        _six(F.col("similarity_score")).alias("similarity_score"), "raw_content",
    )


def _label_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One search per label, for the mean of its vectors; some limits are out of range."""
    values = tables.embeddings(spark, folder).select("label", F.posexplode("embedding").alias("pos", "value"))
    means = values.groupBy("label", "pos").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy("label").agg(F.transform(listed, lambda v: v["mean"].cast("float")).alias("embedding")).select(
        F.col("label").alias("query_id"), "embedding", (F.col("label") * 9 - 10).alias("requested")
    )


def _batch(found: DataFrame) -> DataFrame:
    return found.select("query_id", "rank", "article_id", _six(F.col("similarity_score")).alias("similarity_score"))


@query
def knn_batch(spark, folder):
    stored, asked = tables.embeddings(spark, folder), _label_queries(spark, folder)
    return _batch(search.batch_search(stored, asked, 64, tables.articles(spark, folder)))


@query
def knn_batch_blocks(spark, folder):
    """As ``knn_batch``, by the way taken when the query table is too large to ship."""
    stored, asked = tables.embeddings(spark, folder), _label_queries(spark, folder)
    return _batch(search.batch_search(stored, asked, 64, tables.articles(spark, folder), block_values=64 * 4))


@query
def knn_approx(spark, folder):
    """Over an index that is written first, as it would be used."""
    path = session.shared_folder(spark, "index")
    ann.write_index(tables.embeddings(spark, folder), 64, path)
    near = ann.search_index(ann.open_index(spark, path), _first_vector(spark, folder), 10)
    return near.select("article_id", _six(F.col("distance")).alias("distance"))


@query
def knn_batch_index(spark, folder):
    """Every label's search over the written index: only the buckets that some query probes are read."""
    path = session.shared_folder(spark, "index")
    ann.write_index(tables.embeddings(spark, folder), 64, path)
    return _batch(ann.search_index_batch(ann.open_index(spark, path), _label_queries(spark, folder), 64))


def _graph(spark: SparkSession, folder: str) -> graph.Graph:
    path = session.shared_folder(spark, "graph")
    graph.write_graph(tables.embeddings(spark, folder), 64, path)
    return graph.open_graph(spark, path, 64)


@query
def knn_graph(spark, folder):
    """Every label's search over graphs that are written first."""
    return _batch(graph.search_graph(_graph(spark, folder), _label_queries(spark, folder), effort=256))


@query
def knn_graph_recall(spark, folder):
    """Searches for the vectors with an id divisible by 20: hits asked for, and whether the graphs give at least 95 % of those
    the exact search gives."""
    stored = tables.embeddings(spark, folder)
    asked = stored.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.lit(10).alias("requested"))
    near = graph.search_graph(_graph(spark, folder), asked).select("query_id", "article_id", F.lit(1).alias("found"))
    exact = search.batch_search(stored, asked, 64).select("query_id", "article_id")
    both = exact.join(near, ["query_id", "article_id"], "left").agg(F.count("*").alias("hits"), F.count("found").alias("found"))
    return both.select("hits", (F.col("found") >= 0.95 * F.col("hits")).alias("recalled"))


@query
def search_requests(spark, folder):
    """Limit and blank-text rules over every turn of every conversation."""
    turns = tables.read(spark, folder, "conversations")
    return turns.select(
        "conv_id",
        "turn",
        rules.hit_limit_column(F.col("turn") * 30 - 30).alias("k"),
        rules.query_error(F.col("text")).alias("reason"),
    )


@query
def search_limits(spark, folder):
    """Limits as clients send them, as text."""
    turn = F.col("turn")
    asked = (
        F.when(turn % 6 == 0, F.concat(F.lit(" "), turn.cast("string")))
        .when(turn % 6 == 1, F.concat(F.lit("+"), turn.cast("string")))
        .when(turn % 6 == 2, F.lit("99999999999999999999"))
        .when(turn % 6 == 3, F.concat(turn.cast("string"), F.lit("_0")))
        .when(turn % 6 == 4, (turn * 20).cast("string"))
        .otherwise(F.col("text"))
    )
    turns = tables.read(spark, folder, "conversations").select("conv_id", "turn", asked.alias("asked"))
    return turns.select("conv_id", "turn", rules.hit_limit_of_text(F.col("asked")).alias("k"))


@query
def search_json(spark, folder):
    hits = search.search(
        tables.articles(spark, folder), tables.embeddings(spark, folder), _first_vector(spark, folder), 50
    )
    document = F.col("document")

    def field(path: str) -> Column:
        return F.get_json_object(document, f"$.{path}")

    return search.result_documents(hits).select(
        "id",
        field("article.title").alias("title"),
        field("article.raw_content").alias("raw_content"),
        field("article.published_at").alias("published_at"),
        field("article.created_at").alias("created_at"),
        field("article.quality_score").cast("int").alias("quality_score"),
        _six(field("similarity_score").cast("double")).alias("similarity_score"),
    )


@query
def search_count(spark, folder):
    hits = search.search(
        tables.articles(spark, folder), tables.embeddings(spark, folder), _first_vector(spark, folder), 500
    )
    return search.response(hits, "first vector").select("query", "count", F.size("results").alias("documents"))


@query
def mrl_reduce(spark, folder):
    short = tables.embeddings(spark, folder).select("vec_id", vectors.mrl_reduce(F.col("embedding"), 16).alias("v"))
    return short.select(
        "vec_id", F.posexplode("v").alias("pos", "value"), F.round(vectors.sum_of_squares(F.col("v")), 5).alias("norm2")
    ).select("vec_id", "pos", _six(F.col("value").cast("double")).alias("value"), "norm2")


# registry


@query
def active_feeds(spark, folder):
    return registry.active_feeds(tables.feeds(spark, folder)).select("id", "url", "name", _stamp("created_at"))


@query
def feeds_newest(spark, folder):
    return registry.newest_feeds(tables.feeds(spark, folder)).select("id", "url", "name", "is_active", _stamp("created_at"))


@query
def feed_lookup(spark, folder):
    wanted = (
        tables.read(spark, folder, "documents")
        .select(tables.feed_url(F.col("source")).alias("url"))
        .unionByName(tables.read(spark, folder, "pages").select("url"))
    )
    return registry.lookup_by_url(tables.feeds(spark, folder), wanted).select("url", "id", "name")


@query
def feed_by_id(spark, folder):
    """Ids in another accepted spelling, next to texts that are no ids."""
    known = text.uuid_from(tables.feed_url(F.col("source")))
    wanted = (
        tables.read(spark, folder, "documents")
        .select(F.concat(F.lit("{"), F.upper(known), F.lit("}")).alias("id"))
        .unionByName(tables.read(spark, folder, "pages").select(F.col("url").alias("id")))
    )
    return registry.lookup_by_id(tables.feeds(spark, folder), wanted).select("id", "url", "name")


@query
def article_lookup(spark, folder):
    wanted = tables.embeddings(spark, folder).select("article_id")
    found = registry.lookup_by_id(tables.articles(spark, folder), wanted, "article_id")
    return found.select("id", "feed_id", "title", "url", "quality_score")


def _kept(spark: SparkSession, frame: DataFrame, key: str, parts: int | None = None) -> keyed.Keyed:
    return keyed.write_keyed(frame, key, session.shared_folder(spark, "keyed"), parts)


@query
def keyed_lookup(spark, folder):
    """As ``article_lookup``, over a table kept by key."""
    table = _kept(spark, tables.articles(spark, folder), "id")
    wanted = tables.embeddings(spark, folder).select(F.col("article_id").alias("id"))
    return keyed.find_all(spark, table, wanted).select("id", "feed_id", "title", "url", "quality_score")


def _feed_requests(spark: SparkSession, folder: str) -> DataFrame:
    docs = tables.read(spark, folder, "documents")
    nothing = F.lit(None).cast("string")
    pages = tables.read(spark, folder, "pages").select(
        F.col("page_id").alias("request_no"),
        "url",
        F.lit("  ").alias("name"),
        F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("discovered"),
    )
    known = docs.select(
        (F.col("doc_id") + 1000000000).alias("request_no"),
        F.concat(F.lit(" "), tables.feed_url(F.col("source")), F.lit("\t")).alias("url"),
        F.col("lang").alias("name"),
        nothing.alias("discovered"),
    )
    # first lines as names: some are longer than a name may be
    fresh = docs.select(
        (F.col("doc_id") + 2000000000).alias("request_no"),
        F.concat(F.lit("https://"), F.col("lang"), F.lit("/"), F.col("source")).alias("url"),
        F.substring_index("text", "\n", 1).alias("name"),
        nothing.alias("discovered"),
    )
    junk = tables.read(spark, folder, "nation").select(
        (F.col("n_nationkey") + F.lit(3000000000)).alias("request_no"),
        F.col("n_name").alias("url"),
        nothing.alias("name"),
        nothing.alias("discovered"),
    )
    return pages.unionByName(known).unionByName(fresh).unionByName(junk)


@query
def feed_add(spark, folder):
    change = registry.add_feeds(tables.feeds(spark, folder), _feed_requests(spark, folder), _as_of())
    return change.table.select("id", "url", "name", "is_active", _stamp("created_at"))


@query
def feed_add_rejected(spark, folder):
    change = registry.add_feeds(tables.feeds(spark, folder), _feed_requests(spark, folder), _as_of())
    return change.rejected.select("request_no", "url", "reason")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, folder, "documents").join(tables.read(spark, folder, "labels"), "doc_id")


def _feed_ids(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("request_no"),
        text.uuid_from(tables.feed_url(F.col("source"))).alias("id"),
        (F.col("quality") == 1).alias("is_active"),
        "toxic",
    )


def _unknown_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, folder, "pages").select(F.col("page_id").alias("request_no"), F.col("url").alias("id"))


def _changed(change: registry.Change) -> DataFrame:
    state = change.table.select("id", "is_active", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("note"))
    return state.unionByName(
        change.rejected.select("id", F.lit(None).cast("boolean").alias("is_active"), F.col("reason").alias("note"))
    )


@query
def feed_toggle(spark, folder):
    wanted = _feed_ids(_labelled(spark, folder)).select("request_no", "id", "is_active")
    wanted = wanted.unionByName(_unknown_ids(spark, folder).withColumn("is_active", F.lit(True)))
    return _changed(registry.set_status(tables.feeds(spark, folder), wanted, _as_of()))


@query
def feed_flip(spark, folder):
    flips = _feed_ids(_labelled(spark, folder)).where("toxic = 1").select("request_no", "id")
    flips = flips.unionByName(_unknown_ids(spark, folder))
    return _changed(registry.flip_status(tables.feeds(spark, folder), flips, _as_of()))


def _doomed(spark: SparkSession, folder: str) -> DataFrame:
    """Feeds with a toxic article, and ids of no feed."""
    doomed = _feed_ids(_labelled(spark, folder)).where("toxic = 1").select("id")
    return doomed.unionByName(_unknown_ids(spark, folder).select("id"))


def _left(feeds: DataFrame, articles: DataFrame, vectors_left: DataFrame, rejected: DataFrame) -> DataFrame:
    def part(frame: DataFrame, key: str, kind: str) -> DataFrame:
        return frame.select(F.lit(kind).alias("kind"), F.col(key).alias("id"))

    return (
        part(feeds, "id", "feed")
        .unionByName(part(articles, "id", "article"))
        .unionByName(part(vectors_left, "article_id", "embedding"))
        .unionByName(part(rejected, "id", "not_found"))
    )


@query
def feed_delete_cascade(spark, folder):
    """Feeds with a toxic article go, and what hangs on them; unknown ids are reported."""
    left = registry.delete_feeds(
        tables.feeds(spark, folder), tables.articles(spark, folder), tables.embeddings(spark, folder), _doomed(spark, folder)
    )
    return _left(left.feeds, left.articles, left.embeddings, left.rejected)


@query
def keyed_delete_cascade(spark, folder):
    """As ``feed_delete_cascade``, in tables kept by key: only the partitions of deleted rows are written."""
    feeds, articles = _kept(spark, tables.feeds(spark, folder), "id"), _kept(spark, tables.articles(spark, folder), "id", 64)
    stored = _kept(spark, tables.embeddings(spark, folder).select("article_id", "embedding", "created_at"), "article_id", 64)
    rejected = keyed.delete_feeds(spark, feeds, articles, stored, _doomed(spark, folder))
    return _left(keyed.rows(spark, feeds), keyed.rows(spark, articles), keyed.rows(spark, stored), rejected)


# ingestion


@query
def items_clean(spark, folder):
    entries = tables.read(spark, folder, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("url").alias("link"),
        F.lit(" ").alias("content"),
        F.col("html").alias("description"),
        F.lit(None).cast("timestamp").alias("published"),
        tables.after(F.col("page_id")).alias("updated"),
    )
    return ingest.normalise_items(entries).select("page_id", "title", "url", "content", _stamp("published_at"))


@query
def dedup_in_run(spark, folder):
    first = ingest.first_per_url(tables.items(spark, folder))
    return first.select("url", "feed_name", "item_pos", "title", "content")


@query
def new_items(spark, folder):
    fresh = ingest.new_items(
        tables.items(spark, folder), tables.articles(spark, folder), tables.feeds(spark, folder).where("is_active")
    )
    return fresh.select("url", "feed_id", "item_pos", "title", "content", _stamp("published_at"))


@query
def url_counts(spark, folder):
    return ingest.url_counts(tables.items(spark, folder))


@query
def run_counters(spark, folder):
    items = tables.items(spark, folder).drop("content")
    fresh = ingest.new_items(items, tables.articles(spark, folder), tables.feeds(spark, folder))
    return ingest.run_counters(items, fresh)


@query
def article_validation(spark, folder):
    """Titles and URLs of the items with scores that partly lie outside 1..10."""
    rows = tables.items(spark, folder).withColumn("quality_score", (F.col("n_chars") % 13).cast("int"))
    valid, rejected = constraints.split_articles(rows)
    return (
        valid.withColumn("reason", F.lit(None).cast("string"))
        .unionByName(rejected)
        .select("item_pos", "title", "url", "quality_score", "reason")
    )


@query
def rule_report(spark, folder):
    """Items as they come, before any rule was applied, as the articles table."""
    items = tables.items(spark, folder).select(
        tables.numbered_id(F.col("item_pos")).alias("id"), "feed_id", "title", "url", "item_pos",
        (F.col("n_chars") % 13).cast("int").alias("quality_score"),
    )
    vectors_of = tables.embeddings(spark, folder)
    # vectors cut to different lengths, and filed twice under some ids
    stored = vectors_of.select(
        tables.numbered_id(F.floor(F.col("vec_id") / 2) * 3).alias("article_id"),
        vectors.mrl_reduce(F.col("embedding"), 32).alias("embedding"),
    ).unionByName(vectors_of.select("article_id", "embedding"))
    asked = tables.read(spark, folder, "conversations").select(
        F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit(" \t")).alias("query")
    )
    live = tables.feeds(spark, folder).where("is_active")
    return constraints.rule_report(live, items, stored, asked, 64)


@query
def xml_items(spark, folder):
    raw = tables.raw_feeds(tables.read(spark, folder, "documents"))
    items = ingest.normalise_items(feed_documents.entries(raw))
    return items.select("feed_id", _stamp("fetched_at"), "item_pos", "title", "url", "content", _stamp("published_at"))


@query
def xml_titles(spark, folder):
    raw = tables.raw_feeds(tables.read(spark, folder, "documents"))
    parsed = feed_documents.parse(raw)
    return parsed.select("feed_id", _stamp("fetched_at"), "readable", F.col("feed_title").alias("title"))


# enrichment


@query
def score_clamp(spark, folder):
    """Model answers of every kind, made from the documents, decoded and clamped."""
    docs = tables.read(spark, folder, "documents")
    n = F.col("n_chars")
    score = (
        F.when(F.col("lang") == "fr", F.lit("null"))
        .when(F.col("lang") == "de", F.concat((n % 12).cast("string"), F.lit(".5")))
        .when(F.col("lang") == "es", (n % 3 * 3000000000).cast("string"))  # beyond 32 bits
        .otherwise((n % 15 - 2).cast("string"))
    )
    quoted = F.to_json(F.struct(F.col("text").alias("t")))
    response = F.concat(
        F.lit('{"three_line_summary": '), F.substring(quoted, F.lit(6), F.length(quoted) - 6),
        F.lit(', "key_takeaways": ["a"], "quality_score": '), score,
        F.when(F.col("text").contains("|"), F.lit("")).when(n % 10 == 3, F.lit("} and more")).otherwise(F.lit("}")),
    )
    rows = docs.select("doc_id", response.alias("response"), F.lit(None).cast("string").alias("error"))
    answer = enrich.with_answer(rows)
    return answer.select("doc_id", F.col("three_line_summary").alias("summary"), "quality_score", "error")


@query
def format_summary(spark, folder):
    """Lines as takeaways of the whole text; a text of one line has none."""
    lines = F.split("text", "\n")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    formatted = text.format_summary(F.concat(F.lit(" \n"), lines[0]), rest)
    return tables.read(spark, folder, "documents").select("doc_id", formatted.alias("summary"))


def _fresh(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.new_items(
        tables.items(spark, folder), tables.articles(spark, folder), tables.feeds(spark, folder).where("is_active")
    )


@query
def enrich_offline(spark, folder):
    provider = enrich.OfflineProvider()
    valid, _ = enrich.enrich_items(_fresh(spark, folder), provider, _as_of())
    made, _ = enrich.embed_articles(valid, provider, _as_of())
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
    size = made.select(F.col("article_id").alias("id"), F.size("embedding").alias("dim"), _six(total).alias("total"))
    return valid.join(size, "id").select("id", "url", "summary", "quality_score", "dim", "total", _stamp("created_at"))


@query
def enrich_kept(spark, folder):
    """The articles of a run whose answers an earlier run has kept, all but those of every third item."""
    provider = answers.KeptProvider(enrich.OfflineProvider(), session.shared_folder(spark, "answers"))
    fresh = session.staged(_fresh(spark, folder), "fresh")  # read once for each question to the store
    provider.summarise(fresh.where(F.crc32(F.col("url").cast("binary")) % 3 != 0))
    valid, _ = enrich.enrich_items(fresh, provider, _as_of())
    return valid.select("id", "url", "summary", "quality_score", _stamp("created_at"))


def _first_model(client: str, prompt: str) -> str:
    """Stands for a model that fails on some prompts and scores by their length."""
    if "|" in prompt:
        raise TimeoutError("quota")
    return json.dumps({"three_line_summary": client, "key_takeaways": ["a", "b"], "quality_score": len(prompt) % 14})


def _second_model(client: str, prompt: str) -> str:
    if prompt.count("|") > 100:
        raise ValueError("no answer")
    return json.dumps({"three_line_summary": client, "key_takeaways": [], "quality_score": len(prompt) % 14})


def _measure(client: str, words: str) -> list[float]:
    return [float(len(words)), float(words.count("e")), 1.0]


def _measures(client: str, texts: list[str]) -> list[list[float]]:
    return [_measure(client, words) for words in texts]


def _odd_measure(client: str, words: str) -> list[float]:
    """Stands for a model that fails on some texts and is short of values on others."""
    if len(words) % 5 == 0:
        raise ValueError("no vector")
    return _measure(client, words)[: 1 if len(words) % 7 == 0 else 3]


def _models(embed: enrich.Call = _measures) -> enrich.ModelProvider:
    return enrich.ModelProvider(
        (
            enrich.Model(lambda: "first", enrich.one_by_one(_first_model), embed),
            enrich.Model(lambda: "second", enrich.one_by_one(_second_model), _measures),
        )
    )


@query
def enrich_models(spark, folder):
    """Two models in turn over every item: answers, and the items both failed on."""
    storable, _ = ingest.split_storable(tables.items(spark, folder).drop("url").withColumn("url", _item_url()))
    valid, failed = enrich.enrich_items(storable, _models(), _as_of())
    return valid.select("url", "summary", "quality_score").unionByName(
        failed.select("url", F.col("reason").alias("summary"), F.lit(0).alias("quality_score"))
    )


def _item_url() -> Column:
    """One URL per item, so that copies stay apart."""
    return F.concat(F.lit("https://item/"), F.col("item_pos"))


@query
def embed_models(spark, folder):
    """Vectors of the stored summaries, cut to two dimensions."""
    made, _ = enrich.embed_articles(tables.articles(spark, folder), _models(), _as_of(), dim=2)
    first, second = (_six(F.col("embedding")[i].cast("double")) for i in (0, 1))
    return made.select("article_id", first.alias("first"), second.alias("second"))


@query
def embed_rejects(spark, folder):
    """Vectors by a model that fails at times, and the articles left without one."""
    provider = _models(enrich.one_by_one(_odd_measure))
    made, lost = enrich.embed_articles(tables.articles(spark, folder), provider, _as_of(), dim=2)
    size = made.select("article_id", F.size("embedding").alias("dim"), F.lit(None).cast("string").alias("reason"))
    return size.unionByName(lost.select("article_id", F.lit(0).alias("dim"), "reason"))


@query
def insert_articles(spark, folder):
    valid, _ = enrich.enrich_items(_fresh(spark, folder), enrich.OfflineProvider(), _as_of())
    table = ingest.insert_articles(tables.articles(spark, folder), valid)
    return table.select("id", "feed_id", "title", "url", "raw_content", "quality_score", _stamp("created_at"))


def _updates(stored: DataFrame) -> DataFrame:
    """Two updates for every second or third article number; the later one wins."""
    return stored.select(
        tables.numbered_id(F.floor(F.col("vec_id") / 2) * 3).alias("article_id"),
        F.reverse("embedding").alias("embedding"),
        tables.after(F.col("vec_id") * 86400).alias("created_at"),
    )


def _heads(table: DataFrame) -> DataFrame:
    return table.select("article_id", _six(F.col("embedding")[0].cast("double")).alias("head"), _stamp("created_at"))


@query
def embedding_upsert(spark, folder):
    stored = tables.embeddings(spark, folder)
    return _heads(embeddings.upsert_embeddings(stored, _updates(stored), 64)[0])


@query
def keyed_upsert(spark, folder):
    """As ``embedding_upsert``, in a table kept by key."""
    stored = tables.embeddings(spark, folder)
    table = _kept(spark, stored.select("article_id", "embedding", "created_at"), "article_id")
    keyed.upsert_vectors(spark, table, _updates(stored), 64)
    return _heads(keyed.rows(spark, table))


@query
def redimension(spark, folder):
    table = embeddings.redimension(tables.articles(spark, folder), enrich.OfflineProvider(), 256, "offline", _as_of())
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return table.select("article_id", "model", F.size("embedding").alias("dim"), F.round(total, 4).alias("total"))


@query
def reduce_stored(spark, folder):
    table = embeddings.reduce_stored(tables.embeddings(spark, folder), 32, "leading-32")
    return table.select(
        "article_id", "model", F.size("embedding").alias("dim"),
        F.round(vectors.sum_of_squares(F.col("embedding")), 5).alias("norm2"),
        _six(F.col("embedding")[31].cast("double")).alias("tail"),
    )


# ranking and digests


def _top(frame: DataFrame) -> DataFrame:
    return frame.select("id", "title", "url", "quality_score", _stamp("created_at"))


@query
def top_today(spark, folder):
    return _top(ranking.top_of_day(tables.articles(spark, folder), _as_of(), 5))


@query
def top_fallback(spark, folder):
    return _top(ranking.top_or_latest(tables.articles(spark, folder), _later(), 0))


def _ranking(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The articles by day, written in two runs, and the ranking that these kept."""
    path = session.shared_folder(spark, "ranking")
    articles = session.staged(tables.articles(spark, folder), "articles")
    for part in (articles.where("quality_score % 2 = 0"), articles.where("quality_score % 2 = 1")):
        ingest.write_articles(part, f"{path}/articles", folders=False)
        ranking.keep_ranking(part, f"{path}/kept")
    return daily.read_articles(spark, f"{path}/articles"), spark.read.parquet(f"{path}/kept")


@query
def top_today_kept(spark, folder):
    """As ``top_today``, from the kept ranking; its day is past, so the articles are asked as well."""
    return _top(ranking.top_from_kept(*_ranking(spark, folder), _as_of(), 5))


@query
def top_fallback_kept(spark, folder):
    """As ``top_fallback``, from the kept ranking alone."""
    return _top(ranking.top_from_kept(*_ranking(spark, folder), _later(), 0))


@query
def top_per_day(spark, folder):
    best = ranking.top_per_day(tables.articles(spark, folder), 3)
    return best.select(F.col("day").cast("string").alias("day"), "rank", "id", "title", "quality_score")


def _digests(spark: SparkSession, folder: str) -> DataFrame:
    return digest.gather(ranking.top_per_day(tables.articles(spark, folder), 5))


@query
def digest_html(spark, folder):
    return digest.html(_digests(spark, folder)).select(F.col("digest_date").cast("string").alias("digest_date"), "body")


@query
def digest_md(spark, folder):
    return digest.markdown(_digests(spark, folder)).select(F.col("digest_date").cast("string").alias("digest_date"), "body")


@query
def digest_chunks(spark, folder):
    sent = digest.deliverable(_digests(spark, folder))
    return sent.select(F.col("digest_date").cast("string").alias("digest_date"), "chunk_no", "body")


# text functions


@query
def plain_text(spark, folder):
    return tables.read(spark, folder, "pages").select("page_id", text.to_plain_text(F.col("html")).alias("plain"))


@query
def escape_quoted(spark, folder):
    return tables.read(spark, folder, "pages").select(
        "page_id",
        text.escape_html(F.col("html")).alias("escaped"),
        text.escape_html(F.col("html"), quotes=True).alias("quoted"),
    )


@query
def truncate_text(spark, folder):
    return tables.read(spark, folder, "documents").select(
        "doc_id", text.truncate_bytes(F.col("text"), text.EMBED_BYTES).alias("cut")
    )


@query
def prompt_text(spark, folder):
    prompt = text.build_prompt(F.col("title"), F.col("content"))
    return tables.items(spark, folder).select("item_pos", F.length(prompt).alias("size"), prompt.alias("prompt"))


@query
def split_text(spark, folder):
    pieces = F.posexplode(text.split_message(F.col("text"))).alias("piece_no", "piece")
    return tables.read(spark, folder, "documents").select("doc_id", pieces)


# whole jobs


def _run(spark: SparkSession, folder: str) -> daily.Run:
    return daily.run_daily(
        tables.feeds(spark, folder),
        tables.articles(spark, folder),
        tables.raw_feeds(tables.read(spark, folder, "documents")),
        enrich.OfflineProvider(),
        _as_of(),
        session.shared_folder(spark, "daily"),
    )


@query
def daily_run(spark, folder):
    chunks = _run(spark, folder).chunks
    return chunks.select(F.col("digest_date").cast("string").alias("digest_date"), "chunk_no", "body")


@query
def daily_articles(spark, folder):
    new = _run(spark, folder).articles
    return new.select("id", "feed_id", "title", "url", "raw_content", "quality_score", _stamp("created_at"))


@query
def daily_vectors(spark, folder):
    made = _run(spark, folder).embeddings
    return made.select("article_id", F.size("embedding").alias("dim"), _stamp("created_at"))


@query
def daily_rejected(spark, folder):
    return _run(spark, folder).rejected


@query
def daily_counters(spark, folder):
    """Items checked and articles made, with a row of the given table beside them."""
    run = _run(spark, folder)
    documents = tables.read(spark, folder, "documents").agg(F.count("*").alias("documents"))
    return documents.select("documents", F.lit(run.items_checked).alias("checked"), F.lit(run.new_articles).alias("new"))


def _history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The stored articles as a run leaves them: by day, with their filters beside them."""
    path = session.shared_folder(spark, "history")
    ingest.write_articles(tables.articles(spark, folder), f"{path}/articles", folders=False)
    written = daily.read_articles(spark, f"{path}/articles")
    seen.write_filters(written, f"{path}/filters")
    return written, spark.read.parquet(f"{path}/filters")


@query
def unseen_by_filters(spark, folder):
    """Storable URLs that are not stored, found by the filters and the days they name."""
    stored, filters = _history(spark, folder)
    storable, _ = ingest.split_storable(tables.items(spark, folder))
    urls = session.staged(storable.select("url").distinct(), "urls")
    return seen.unseen_by_filters(urls, stored, filters)


@query
def filter_days(spark, folder):
    """Every stored day is named by the filters for the URLs it holds."""
    stored, filters = _history(spark, folder)
    return seen.parts_with(stored.select("url"), filters).select(F.col("day").cast("string").alias("day"))


@query
def daily_filtered(spark, folder):
    """Articles of a run that looks at the history through its filters."""
    stored, filters = _history(spark, folder)
    run = daily.run_daily(
        tables.feeds(spark, folder), stored, tables.raw_feeds(tables.read(spark, folder, "documents")),
        enrich.OfflineProvider(), _as_of(), session.shared_folder(spark, "daily"), filters=filters,
    )
    return run.articles.select("id", "feed_id", "title", "url", "raw_content", "quality_score", _stamp("created_at"))


#: Bytes of text of a file that arrives.
_ARRIVING = 64 << 20


def _stream(spark: SparkSession, folder: str) -> str:
    """The documents as bodies that arrive in three batches, each of as many files as keep one below ``_ARRIVING`` bytes."""
    out = session.shared_folder(spark, "stream")
    documents = tables.read(spark, folder, "documents")
    bodies = tables.raw_feeds(documents)
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    each = max(1, math.ceil(size / (3 * _ARRIVING)))
    bodies.repartition(3 * each, "fetched_at").write.parquet(f"{out}/arriving")
    arriving = spark.readStream.schema(bodies.schema).option("maxFilesPerTrigger", each).parquet(f"{out}/arriving")
    ingest_stream.ingest_available(
        arriving,
        tables.feeds(spark, folder),
        tables.articles(spark, folder),
        enrich.OfflineProvider(),
        _as_of(),
        out,
        f"{out}/checkpoint",
    ).awaitTermination()
    return out


@query
def stream_ingest(spark, folder):
    """Articles of all batches beside their vectors."""
    out = _stream(spark, folder)
    made = ingest_stream.written(spark, out, "embeddings").select(F.col("article_id").alias("id"), F.size("embedding").alias("dim"))
    return ingest_stream.written(spark, out).select("id", "url").join(made, "id", "left")


@query
def stream_rejected(spark, folder):
    rejected = ingest_stream.written(spark, _stream(spark, folder), "rejected")
    return rejected.select("stage", "feed_id", "url", "reason")
