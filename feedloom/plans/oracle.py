"""The same results as SQL over the given tables, for comparison in DuckDB."""

from __future__ import annotations

# Written out here and not imported, so that an error in the library's copy shows.
SPACE_CLASS = r"\t\n\x0B\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_PROMPT_HEAD = """Read the article below for the readers of the daily digest and answer with one JSON object of three fields:
- three_line_summary: what it says, in three short sentences.
- key_takeaways: a list of two things a reader can put to use.
- quality_score: a whole number between 1 and 10, where 1 means empty and 10 means thorough.

Article Title: """
_OFFLINE_TAIL = (
    " discusses core concepts.\n2. Deep dive into practical implementation.\n3. Highlights future directions and impact."
    "\n\n💡 Key Takeaways:\n• Modular architecture improves long-term maintainability."
    "\n• Vector embeddings enable fast semantic retrieval."
)
_AS_OF = "TIMESTAMP '2024-01-02 12:00:00'"
_DAY = "TIMESTAMP '2024-01-02 00:00:00'"


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _uuid(value: str) -> str:
    h = f"md5({value})"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || "
        f"substr({h}, 17, 4) || '-' || substr({h}, 21, 12))"
    )


def _numbered(number: str) -> str:
    return f"('00000000-0000-4000-8000-' || lpad(CAST({number} AS VARCHAR), 12, '0'))"


def _trim(value: str) -> str:
    return f"regexp_replace({value}, '^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$', '', 'g')"


def _strip(value: str) -> str:
    return f"trim(regexp_replace(regexp_replace({value}, '<[^>]*>', ' ', 'g'), '[{SPACE_CLASS}]+', ' ', 'g'))"


def _stamp(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"


def _escape(value: str, quotes: bool = False) -> str:
    out = f"replace(replace(replace({value}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"replace({out}, '\"', '&quot;')" if quotes else out


def _offline_summary(title: str) -> str:
    return f"('1. ' || {title} || {_q(_OFFLINE_TAIL)})"


_FEED_URL = "('https://' || source || '/rss')"
_EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"

_VIEWS = f"""
v_feeds AS (
  SELECT {_uuid(_FEED_URL)} AS id, {_FEED_URL} AS url, source AS name, source NOT LIKE '%3' AS is_active,
         {_EPOCH} + min(doc_id) * INTERVAL 1 HOUR AS created_at
  FROM documents GROUP BY source),
v_items AS (
  SELECT {_uuid(_FEED_URL)} AS feed_id, source AS feed_name, doc_id AS item_pos,
         {_trim("split_part(text, chr(10), 1)")} AS title, 'https://ex/' || md5(text) AS url,
         text AS content, n_chars, {_EPOCH} + doc_id * INTERVAL 1 MINUTE AS published_at, lang
  FROM documents),
v_articles AS (
  SELECT {_numbered("item_pos")} AS id, feed_id, title, url, content AS raw_content, {_offline_summary("title")} AS summary,
         CAST(1 + 4 * quality + n_chars % 6 AS INTEGER) AS quality_score, published_at,
         {_EPOCH} + item_pos * INTERVAL 1 HOUR AS created_at
  FROM (SELECT i.*, l.quality, row_number() OVER (PARTITION BY url ORDER BY item_pos) AS rn
        FROM v_items i JOIN labels l ON l.doc_id = i.item_pos
        WHERE length(title) BETWEEN 1 AND 1024) t
  WHERE rn = 1),
v_embeddings AS (
  SELECT {_numbered("vec_id")} AS article_id, CAST(embedding AS DOUBLE[]) AS embedding, vec_id, label,
         {_EPOCH} + vec_id * INTERVAL 1 HOUR AS created_at
  FROM embeddings),
v_first AS (SELECT embedding AS q FROM v_embeddings WHERE vec_id = 0),
v_new AS (
  SELECT * FROM (
    SELECT i.*, row_number() OVER (PARTITION BY url ORDER BY feed_name, feed_id, item_pos) AS rn
    FROM v_items i WHERE length(title) BETWEEN 1 AND 1024 AND feed_id IN (SELECT id FROM v_feeds WHERE is_active)) t
  WHERE rn = 1 AND url NOT IN (SELECT url FROM v_articles))"""


def _with(body: str, *more: str, recursive: bool = False) -> str:
    parts = ",\n".join([_VIEWS, *more])
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body}"


_NEAREST = """v_hits AS (
  SELECT article_id, 1 - list_cosine_similarity(embedding, q) AS distance
  FROM v_embeddings, v_first WHERE article_id IN (SELECT id FROM v_articles))"""


def _hits(k: int) -> str:
    return f"v_top AS (SELECT * FROM v_hits ORDER BY round(distance, 12), article_id LIMIT {k})"


_LABEL_QUERIES = """v_parts AS (
  SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM v_embeddings),
v_asked AS (
  SELECT label AS query_id, list(CAST(CAST(mean AS FLOAT) AS DOUBLE) ORDER BY pos) AS q,
         least(50, CASE WHEN label * 9 - 10 > 0 THEN label * 9 - 10 ELSE 5 END) AS k
  FROM (SELECT label, pos, avg(v) AS mean FROM v_parts GROUP BY label, pos) m GROUP BY label),
v_ranked AS (
  SELECT query_id, k, article_id, list_cosine_similarity(embedding, q) AS sim,
         row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_cosine_similarity(embedding, q), 12), article_id) AS rank
  FROM v_embeddings, v_asked WHERE article_id IN (SELECT id FROM v_articles))"""

_KNN_BATCH = _with(
    "SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(rank AS INTEGER) AS rank, article_id, round(sim, 6) AS similarity_score FROM v_ranked WHERE rank <= k",
    _LABEL_QUERIES,
)

# the planes by their rule and number, buckets by the squared margins of the planes
# crossed, until the running size reaches the wanted number of candidates
_KNN_APPROX = _with(
    """SELECT article_id, round(1 - list_cosine_similarity(embedding, q), 6) AS distance
FROM v_filed JOIN v_probes USING (bucket), v_first, v_size WHERE before < wanted
ORDER BY round(1 - list_cosine_similarity(embedding, q), 12), article_id LIMIT 10""",
    """v_size AS (
  SELECT least(16, greatest(1, CAST(ceil(log2(greatest(count(*), 2)) / 2) AS INTEGER))) AS bits,
         greatest(100, ceil(2 * pow(count(*), 0.75))) AS wanted FROM v_embeddings),
v_planes AS (
  SELECT b, list(sin(CAST(b * 64 + d + 1 AS DOUBLE) * CAST(b * 64 + d + 1 AS DOUBLE) * 0.6180339887) ORDER BY d) AS normal
  FROM range(16) t(b), range(64) u(d) WHERE b < (SELECT bits FROM v_size) GROUP BY b),
v_filed AS (
  SELECT article_id, embedding, vec_id,
         CAST(sum(CASE WHEN list_dot_product(embedding, normal) >= 0 THEN 1 << CAST(b AS INTEGER) ELSE 0 END) AS INTEGER) AS bucket
  FROM v_embeddings, v_planes GROUP BY article_id, embedding, vec_id),
v_margins AS (SELECT b, list_dot_product(q, normal) AS margin FROM v_first, v_planes),
v_filled AS (SELECT bucket AS c, count(*) AS n FROM v_filed GROUP BY bucket),
v_probes AS (
  SELECT c AS bucket, sum(n) OVER (ORDER BY round(cost, 12), c ROWS UNBOUNDED PRECEDING) - n AS before FROM (
    SELECT c, n, sum(CASE WHEN ((c >> CAST(b AS INTEGER)) & 1) <> (CASE WHEN margin >= 0 THEN 1 ELSE 0 END) THEN margin * margin ELSE 0 END) AS cost
    FROM v_filled, v_margins GROUP BY c, n) s)""",
)

_KNN_EVERY = "SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(rank AS INTEGER) AS rank, article_id, round(sim, 6) AS similarity_score FROM v_ranked WHERE rank <= k"
_ALL_VECTORS = _LABEL_QUERIES.replace(" WHERE article_id IN (SELECT id FROM v_articles)", "")
_KNN_GRAPH = _with(_KNN_EVERY, _ALL_VECTORS)

# as above, with margins and a wanted number of candidates for each query
_KNN_BATCH_INDEX = _with(
    """SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(rank AS INTEGER) AS rank, article_id, round(sim, 6) AS similarity_score FROM (
  SELECT query_id, k, article_id, list_cosine_similarity(embedding, q) AS sim,
         row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_cosine_similarity(embedding, q), 12), article_id) AS rank
  FROM v_filed JOIN v_probes USING (bucket) JOIN v_asked USING (query_id, k) WHERE before < wanted) t
WHERE rank <= k""",
    _ALL_VECTORS,
    """v_bits AS (SELECT least(16, greatest(1, CAST(ceil(log2(greatest(count(*), 2)) / 2) AS INTEGER))) AS bits, count(*) AS total FROM v_embeddings),
v_planes AS (
  SELECT b, list(sin(CAST(b * 64 + d + 1 AS DOUBLE) * CAST(b * 64 + d + 1 AS DOUBLE) * 0.6180339887) ORDER BY d) AS normal
  FROM range(16) t(b), range(64) u(d) WHERE b < (SELECT bits FROM v_bits) GROUP BY b),
v_filed AS (
  SELECT article_id, embedding, vec_id,
         CAST(sum(CASE WHEN list_dot_product(embedding, normal) >= 0 THEN 1 << CAST(b AS INTEGER) ELSE 0 END) AS INTEGER) AS bucket
  FROM v_embeddings, v_planes GROUP BY article_id, embedding, vec_id),
v_margins AS (SELECT query_id, k, b, list_dot_product(q, normal) AS margin FROM v_asked, v_planes),
v_filled AS (SELECT bucket AS c, count(*) AS n FROM v_filed GROUP BY bucket),
v_probes AS (
  SELECT query_id, k, c AS bucket, greatest(10 * k, ceil(2 * pow(total, 0.75))) AS wanted,
         sum(n) OVER (PARTITION BY query_id ORDER BY round(cost, 12), c ROWS UNBOUNDED PRECEDING) - n AS before FROM (
    SELECT query_id, k, c, n, sum(CASE WHEN ((c >> CAST(b AS INTEGER)) & 1) <> (CASE WHEN margin >= 0 THEN 1 ELSE 0 END) THEN margin * margin ELSE 0 END) AS cost
    FROM v_filled, v_margins GROUP BY query_id, k, c, n) s, v_bits)""",
)

_REDUCED = """v_cut AS (
  SELECT {cols}, embedding[1:{dim}] AS head, sqrt(list_sum(list_transform(embedding[1:{dim}], lambda x: x * x))) AS norm FROM v_embeddings)"""


def _reduced(dim: int) -> str:
    cut = _REDUCED.format(cols="article_id, vec_id", dim=dim)
    short = "v_short AS (SELECT article_id, vec_id, list_transform(head, lambda x: CAST(CAST(x / CAST(norm AS FLOAT) AS FLOAT) AS DOUBLE)) AS v FROM v_cut)"
    return f"{cut},\n{short}"


_REQUESTS = f"""v_requests AS (
  SELECT page_id AS request_no, url, {_trim("nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '')")} AS named FROM pages
  UNION ALL SELECT doc_id + 1000000000, {_FEED_URL}, lang FROM documents
  UNION ALL SELECT doc_id + 2000000000, 'https://' || lang || '/' || source,
                   nullif({_trim("split_part(text, chr(10), 1)")}, '') FROM documents
  UNION ALL SELECT n_nationkey + 3000000000, n_name, NULL FROM nation),
v_checked AS (
  SELECT request_no, url, coalesce(named, url) AS name,
         CASE WHEN named = '' THEN 'empty_name'
              WHEN url NOT LIKE 'http://%' AND url NOT LIKE 'https://%' THEN 'invalid_url'
              WHEN length(url) > 2048 THEN 'url_too_long'
              WHEN length(coalesce(named, url)) > 255 THEN 'name_too_long' END AS fault
  FROM v_requests),
v_judged AS (
  SELECT c.*, CASE WHEN url IN (SELECT url FROM v_feeds) OR request_no > winner THEN 'conflict' ELSE fault END AS reason
  FROM (SELECT *, min(CASE WHEN fault IS NULL THEN request_no END) OVER (PARTITION BY url) AS winner FROM v_checked) c)"""

_STATE_TAIL = "UNION ALL SELECT DISTINCT url, NULL, 'not_found' FROM pages"

_LABELLED = f"""v_labelled AS (
  SELECT d.doc_id, {_uuid(_FEED_URL)} AS feed_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"""

_RULE_ROWS = f"""v_live AS (SELECT * FROM v_feeds WHERE is_active),
v_loose AS (SELECT *, n_chars % 13 AS quality_score FROM v_items),
v_stored AS (
  SELECT {_numbered("(vec_id // 2) * 3")} AS article_id, 32 AS dim FROM v_embeddings
  UNION ALL SELECT article_id, len(embedding) FROM v_embeddings)"""

_BLOCK = (
    "'<b>#' || rank || ': <a href=\"' || " + _escape("url") + " || '\">' || " + _escape("title") + " || '</a></b>' || chr(10) || "
    "'⭐ <b>Quality Score:</b> ' || quality_score || '/10' || chr(10) || '📝 <b>Summary:</b>' || chr(10) || "
    + _escape("summary") + " || chr(10) || chr(10) || '─────────────────────' || chr(10) || chr(10)"
)
_HEADER = "'🚀 <b>DAILY DIGEST</b>' || chr(10) || '<i>' || strftime(day, '%A, %d %b %Y') || '</i>' || chr(10) || chr(10)"
_FOOTER = "'<i>Clean, ranked & delivered</i> 🤖'"


def _chunked(ranked: str) -> tuple[str, ...]:
    """Greedy packing as a recursion over the ranks of each day."""
    return (
        ranked,
        f"""v_blocks AS (SELECT day, rank, {_BLOCK} AS block, {_HEADER} AS header FROM v_ranked_days)""",
        """v_pack AS (
  SELECT day, 0 AS rank, header, CAST([] AS VARCHAR[]) AS done, header AS open FROM (SELECT DISTINCT day, header FROM v_blocks) s
  UNION ALL
  SELECT p.day, CAST(b.rank AS INTEGER), p.header,
         CASE WHEN strlen(open) + strlen(block) > 3500 AND strlen(open) > strlen(p.header) THEN list_append(done, open) ELSE done END,
         CASE WHEN strlen(open) + strlen(block) > 3500 AND strlen(open) > strlen(p.header) THEN block ELSE open || block END
  FROM v_pack p JOIN v_blocks b ON b.day = p.day AND b.rank = p.rank + 1)""",
        f"""v_finished AS (
  SELECT day, CASE WHEN strlen(open) + strlen({_FOOTER}) > 3900 THEN list_append(list_append(done, open), {_FOOTER})
                   ELSE list_append(done, open || {_FOOTER}) END AS chunks
  FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY rank DESC) AS last FROM v_pack) t WHERE last = 1)""",
    )


def _per_day(n: int) -> str:
    return f"""v_ranked_days AS (
  SELECT * FROM (SELECT *, CAST(created_at AS DATE) AS day, row_number() OVER (
           PARTITION BY CAST(created_at AS DATE) ORDER BY quality_score DESC, created_at DESC, id) AS rank FROM v_articles) t
  WHERE rank <= {n})"""


_CHUNK_ROWS = """SELECT CAST(day AS VARCHAR) AS digest_date, CAST(generate_subscripts(chunks, 1) - 1 AS INTEGER) AS chunk_no, unnest(chunks) AS body
FROM v_finished"""

_READABLE = "text NOT LIKE '%|%'"
# fr bodies carry their text as a description; every dialect ends in the same items
_PARSED = f"""v_readable AS (
  SELECT i.*, {_strip("content")} AS clean, 0 AS pos FROM v_items i JOIN documents d ON d.doc_id = i.item_pos WHERE {_READABLE}
  UNION ALL
  SELECT i.* REPLACE ('More' AS title, url || '/more' AS url), 'more', 1 FROM v_items i JOIN documents d ON d.doc_id = i.item_pos
  WHERE {_READABLE} AND d.lang = 'de'),
v_fresh AS (
  SELECT * FROM (
    SELECT r.*, row_number() OVER (PARTITION BY url ORDER BY feed_name, feed_id, item_pos, pos) AS rn FROM v_readable r
    WHERE length(title) BETWEEN 1 AND 1024 AND feed_id IN (SELECT id FROM v_feeds WHERE is_active)) t
  WHERE rn = 1 AND url NOT IN (SELECT url FROM v_articles))"""

_REJECTED = f"""SELECT 'parse' AS stage, feed_id, NULL::VARCHAR AS url, 'unreadable' AS reason
FROM v_items JOIN documents d ON d.doc_id = item_pos
WHERE NOT ({_READABLE}) AND feed_id IN (SELECT id FROM v_feeds WHERE is_active)
UNION ALL SELECT 'check', feed_id, url, CASE WHEN title = '' THEN 'empty_title' ELSE 'title_too_long' END FROM v_readable
WHERE NOT length(title) BETWEEN 1 AND 1024 AND feed_id IN (SELECT id FROM v_feeds WHERE is_active)"""

_RUN_RANKED = f"""v_ranked_days AS (
  SELECT * FROM (
    SELECT *, DATE '2024-01-02' AS day, row_number() OVER (ORDER BY quality_score DESC, created_at DESC, id) AS rank FROM (
      SELECT id, title, url, summary, quality_score, created_at FROM v_articles WHERE created_at BETWEEN {_DAY} AND {_AS_OF}
      UNION ALL SELECT {_uuid("url")}, title, url, {_offline_summary("title")}, 8, {_AS_OF} FROM v_fresh) a) t
  WHERE rank <= 5)"""

_TOP = f"SELECT id, title, url, quality_score, {_stamp('created_at')} AS created_at FROM v_articles"
_BEST = "ORDER BY quality_score DESC, created_at DESC, id"


def _cut(limit: int) -> tuple[str, ...]:
    """The longest run of whole characters of at most ``limit`` bytes, for long texts."""
    return (
        f"""v_chars AS (
  SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS n
  FROM documents WHERE strlen(text) > {limit}),
v_sizes AS (SELECT doc_id, n, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY n) AS bytes FROM v_chars),
v_fit AS (SELECT doc_id, max(n) AS n FROM v_sizes WHERE bytes <= {limit} GROUP BY doc_id),
v_cut AS (
  SELECT d.doc_id, CASE WHEN n IS NULL THEN text ELSE substring(text, 1, CAST(n AS INTEGER)) || '...' END AS cut
  FROM documents d LEFT JOIN v_fit USING (doc_id))""",
    )


def _prompts() -> tuple[str, ...]:
    head = _q(_PROMPT_HEAD)
    return (
        *_cut(12000),
        f"""v_prompts AS (
  SELECT item_pos, title, {head} || title || chr(10) || 'Article Content:' || chr(10) || cut || chr(10) AS prompt
  FROM v_items JOIN v_cut ON doc_id = item_pos)""",
    )


_ANSWER_SCORE = "CASE lang WHEN 'fr' THEN 0 WHEN 'es' THEN n_chars % 3 * 3000000000 ELSE n_chars % 15 - 2 END"

def oracle_sql() -> dict[str, str]:
    """One statement per registered query."""
    hit_columns = (
        f"id, feed_id, title, url, summary, quality_score, {_stamp('published_at')} AS published_at, "
        f"{_stamp('created_at')} AS created_at, round(1 - distance, 6) AS similarity_score, raw_content"
    )
    plain = "regexp_replace(html, '<[^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        plain = f"replace({plain}, '{entity}', '{char}')"
    iso = "'%Y-%m-%dT%H:%M:%SZ'"
    sql = {
        "knn_top5": _with(f"SELECT {hit_columns} FROM v_top JOIN v_articles ON id = article_id", _NEAREST, _hits(5)),
        "knn_batch": _KNN_BATCH,
        "knn_batch_blocks": _KNN_BATCH,
        "knn_approx": _KNN_APPROX,
        "knn_batch_index": _KNN_BATCH_INDEX,
        "knn_graph": _KNN_GRAPH,
        "knn_graph_recall": "SELECT count(*) * least(10, (SELECT count(*) FROM embeddings)) AS hits, true AS recalled FROM embeddings WHERE vec_id % 20 = 0",
        "search_requests": """SELECT conv_id, turn, CAST(least(50, CASE WHEN turn * 30 - 30 > 0 THEN turn * 30 - 30 ELSE 5 END) AS INTEGER) AS k,
       CASE WHEN %s = '' THEN 'empty_query' END AS reason FROM conversations""" % _trim("text"),
        "search_limits": """SELECT conv_id, turn, CAST(CASE WHEN k > 0 THEN least(50, k) ELSE 5 END AS INTEGER) AS k FROM (
  SELECT conv_id, turn, CASE turn % 6 WHEN 1 THEN turn WHEN 4 THEN turn * 20
    WHEN 5 THEN CASE WHEN regexp_full_match(text, '[+-]?[0-9]+') THEN TRY_CAST(text AS BIGINT) END END AS k FROM conversations) t""",
        "search_json": _with(
            f"""SELECT id, title, raw_content, strftime(published_at, {iso}) AS published_at, strftime(created_at, {iso}) AS created_at,
       quality_score, round(1 - distance, 6) AS similarity_score FROM v_top JOIN v_articles ON id = article_id""",
            _NEAREST, _hits(50),
        ),
        "search_count": _with(
            "SELECT 'first vector' AS query, count(*) AS count, CAST(count(*) AS INTEGER) AS documents FROM v_top", _NEAREST, _hits(50)
        ),
        "mrl_reduce": _with(
            """SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INTEGER) AS pos, round(unnest(v), 6) AS value,
       round(list_sum(list_transform(v, lambda x: x * x)), 5) AS norm2 FROM v_short""",
            _reduced(16),
        ),
        "active_feeds": _with(f"SELECT id, url, name, {_stamp('created_at')} AS created_at FROM v_feeds WHERE is_active ORDER BY name, id"),
        "feeds_newest": _with(f"SELECT id, url, name, is_active, {_stamp('created_at')} AS created_at FROM v_feeds ORDER BY v_feeds.created_at DESC, id"),
        "feed_lookup": _with(
            f"SELECT w.url, id, name FROM (SELECT {_FEED_URL} AS url FROM documents UNION SELECT url FROM pages) w LEFT JOIN v_feeds f ON f.url = w.url"
        ),
        "feed_by_id": _with("SELECT id, url, name FROM v_feeds"),
        "article_lookup": _with("SELECT id, feed_id, title, url, quality_score FROM v_articles WHERE id IN (SELECT article_id FROM v_embeddings)"),
        "feed_add": _with(
            f"""SELECT id, url, name, is_active, {_stamp('created_at')} AS created_at FROM v_feeds
UNION ALL SELECT {_uuid('url')}, url, name, true, {_q('2024-01-02 12:00:00')} FROM v_judged WHERE reason IS NULL""",
            _REQUESTS,
        ),
        "feed_add_rejected": _with("SELECT request_no, url, reason FROM v_judged WHERE reason IS NOT NULL", _REQUESTS),
        "feed_toggle": _with(
            f"""SELECT f.id, coalesce(wanted, is_active) AS is_active,
       CASE WHEN wanted IS NULL THEN {_stamp('created_at')} ELSE '2024-01-02 12:00:00' END AS note
FROM v_feeds f LEFT JOIN (SELECT feed_id, arg_max(quality = 1, doc_id) AS wanted FROM v_labelled GROUP BY feed_id) c ON c.feed_id = f.id
{_STATE_TAIL}""",
            _LABELLED,
        ),
        "feed_flip": _with(
            f"""SELECT f.id, is_active <> (coalesce(flips, 0) % 2 = 1) AS is_active,
       CASE WHEN flips IS NULL THEN {_stamp('created_at')} ELSE '2024-01-02 12:00:00' END AS note
FROM v_feeds f LEFT JOIN (SELECT feed_id, count(*) AS flips FROM v_labelled WHERE toxic = 1 GROUP BY feed_id) c ON c.feed_id = f.id
{_STATE_TAIL}""",
            _LABELLED,
        ),
        "feed_delete_cascade": _with(
            """SELECT 'feed' AS kind, id FROM v_feeds WHERE id NOT IN (SELECT feed_id FROM v_gone)
UNION ALL SELECT 'article', id FROM v_articles WHERE feed_id NOT IN (SELECT feed_id FROM v_gone)
UNION ALL SELECT 'embedding', article_id FROM v_embeddings
  WHERE article_id NOT IN (SELECT id FROM v_articles WHERE feed_id IN (SELECT feed_id FROM v_gone))
UNION ALL SELECT DISTINCT 'not_found', url FROM pages""",
            _LABELLED,
            "v_gone AS (SELECT DISTINCT feed_id FROM v_labelled WHERE toxic = 1)",
        ),
        "items_clean": f"""SELECT page_id, {_trim("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, {_trim('url')} AS url,
       {_strip('html')} AS content, {_stamp(_EPOCH + ' + page_id * INTERVAL 1 SECOND')} AS published_at FROM pages""",
        "dedup_in_run": _with(
            """SELECT url, feed_name, item_pos, title, content FROM (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY feed_name, feed_id, item_pos) AS rn FROM v_items) t WHERE rn = 1"""
        ),
        "new_items": _with(f"SELECT url, feed_id, item_pos, title, content, {_stamp('published_at')} AS published_at FROM v_new"),
        "url_counts": _with("SELECT url, count(*) AS n FROM v_items GROUP BY url"),
        "run_counters": _with(
            """SELECT feed_id, count(*) AS items_checked,
       count(*) FILTER (WHERE length(title) BETWEEN 1 AND 1024 AND first_of = 1 AND url NOT IN (SELECT url FROM v_articles)) AS new_articles
FROM (SELECT *, row_number() OVER (PARTITION BY url, length(title) BETWEEN 1 AND 1024 ORDER BY feed_name, feed_id, item_pos) AS first_of FROM v_items) t
GROUP BY feed_id"""
        ),
        "article_validation": _with(
            """SELECT item_pos, title, url, CAST(n_chars % 13 AS INTEGER) AS quality_score,
       CASE WHEN title = '' THEN 'empty_title' WHEN n_chars % 13 NOT BETWEEN 1 AND 10 THEN 'invalid_score'
            WHEN length(title) > 1024 THEN 'title_too_long' END AS reason FROM v_items"""
        ),
        "rule_report": _with(
            f"""SELECT 'feed_url_unique' AS rule, count(*) - count(DISTINCT url) AS broken FROM v_live
UNION ALL SELECT 'article_url_unique', count(*) - count(DISTINCT url) FROM v_loose
UNION ALL SELECT 'feed_text_length', count(*) FILTER (WHERE length(url) > 2048 OR length(name) > 255) FROM v_live
UNION ALL SELECT 'article_text_length', count(*) FILTER (WHERE length(url) > 2048 OR length(title) > 1024) FROM v_loose
UNION ALL SELECT 'score_range', count(*) FILTER (WHERE quality_score NOT BETWEEN 1 AND 10) FROM v_loose
UNION ALL SELECT 'article_feed_exists', count(*) FILTER (WHERE feed_id NOT IN (SELECT id FROM v_live)) FROM v_loose
UNION ALL SELECT 'embedding_article_exists', count(*) FILTER (WHERE article_id NOT IN (SELECT {_numbered('item_pos')} FROM v_loose)) FROM v_stored
UNION ALL SELECT 'embedding_unique', count(*) - count(DISTINCT article_id) FROM v_stored
UNION ALL SELECT 'embedding_dimension', count(*) FILTER (WHERE dim <> 64) FROM v_stored
UNION ALL SELECT 'feed_id_uuid', count(*) FILTER (WHERE length(id) <> 36) FROM v_live
UNION ALL SELECT 'article_id_uuid', count(*) FILTER (WHERE length(feed_id) <> 36) FROM v_loose
UNION ALL SELECT 'search_text', count(*) FILTER (WHERE role <> 'user' OR {_trim('text')} = '') FROM conversations""",
            _RULE_ROWS,
        ),
        "xml_items": _with(
            f"""SELECT feed_id, {_stamp('published_at')} AS fetched_at, CAST(pos AS BIGINT) AS item_pos, title, url, clean AS content,
       {_stamp('published_at')} AS published_at FROM v_readable""",
            _PARSED,
        ),
        "xml_titles": f"""SELECT {_uuid(_FEED_URL)} AS feed_id, {_stamp(_EPOCH + ' + doc_id * INTERVAL 1 MINUTE')} AS fetched_at,
       {_READABLE} AS readable, CASE WHEN {_READABLE} THEN source END AS title FROM documents""",
        "score_clamp": f"""SELECT doc_id, CASE WHEN good THEN text END AS summary,
       CASE WHEN good THEN CAST(least(10, greatest(1, {_ANSWER_SCORE})) AS INTEGER) END AS quality_score,
       CASE WHEN NOT good THEN 'bad_response' END AS error
FROM (SELECT *, lang <> 'de' AND {_READABLE} AND n_chars % 10 <> 3 AS good FROM documents) t""",
        "format_summary": f"""SELECT doc_id, {_trim("CASE WHEN len(lines) > 1 THEN ' ' || chr(10) || lines[1] || chr(10) || chr(10) || '💡 Key Takeaways:' || chr(10) || array_to_string(list_transform(lines[2:], lambda x: '• ' || x), chr(10)) ELSE lines[1] END")} AS summary
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents) t""",
        "enrich_offline": _with(
            f"""SELECT {_uuid('url')} AS id, url, {_offline_summary('title')} AS summary, 8 AS quality_score, 768 AS dim,
       (SELECT round(sum(CAST(CAST((i % 10) / 10.0 AS FLOAT) AS DOUBLE)), 6) FROM range(768) t(i)) AS total,
       '2024-01-02 12:00:00' AS created_at FROM v_new"""
        ),
        "enrich_kept": _with(
            f"""SELECT {_uuid('url')} AS id, url, {_offline_summary('title')} AS summary, 8 AS quality_score,
       '2024-01-02 12:00:00' AS created_at FROM v_new"""
        ),
        "enrich_models": _with(
            f"""SELECT 'https://item/' || item_pos AS url,
       CASE WHEN bars = 0 THEN 'first' || chr(10) || chr(10) || '💡 Key Takeaways:' || chr(10) || '• a' || chr(10) || '• b'
            WHEN bars <= 100 THEN 'second' ELSE 'ValueError: no answer' END AS summary,
       CASE WHEN bars > 100 THEN 0 ELSE CAST(least(10, greatest(1, length(prompt) % 14)) AS INTEGER) END AS quality_score
FROM (SELECT *, length(prompt) - length(replace(prompt, '|', '')) AS bars FROM v_prompts) t WHERE length(title) BETWEEN 1 AND 1024""",
            *_prompts(),
        ),
        "embed_models": _with(
            """SELECT id AS article_id, round(CAST(CAST(n AS FLOAT) / CAST(sqrt(n * n + e * e) AS FLOAT) AS DOUBLE), 6) AS first,
       round(CAST(CAST(e AS FLOAT) / CAST(sqrt(n * n + e * e) AS FLOAT) AS DOUBLE), 6) AS second
FROM (SELECT id, CAST(length(summary) AS DOUBLE) AS n, CAST(length(summary) - length(replace(summary, 'e', '')) AS DOUBLE) AS e FROM v_articles) t"""
        ),
        "embed_rejects": _with(
            """SELECT id AS article_id, CAST(CASE WHEN n % 5 = 0 OR n % 7 = 0 THEN 0 ELSE 2 END AS INTEGER) AS dim,
       CASE WHEN n % 5 = 0 THEN 'ValueError: no vector' WHEN n % 7 = 0 THEN 'wrong_dimension' END AS reason
FROM (SELECT id, length(summary) AS n FROM v_articles) t"""
        ),
        "insert_articles": _with(
            f"""SELECT id, feed_id, title, url, raw_content, quality_score, {_stamp('created_at')} AS created_at FROM v_articles
UNION ALL SELECT {_uuid('url')}, feed_id, title, url, content, 8, '2024-01-02 12:00:00' FROM v_new"""
        ),
        "embedding_upsert": _with(
            f"""SELECT article_id, round(embedding[1], 6) AS head, {_stamp('created_at')} AS created_at FROM v_embeddings
WHERE article_id NOT IN (SELECT article_id FROM v_updates)
UNION ALL SELECT article_id, round(arg_max(embedding[-1], vec_id), 6), {_stamp(_EPOCH + ' + max(vec_id) * INTERVAL 1 DAY')}
FROM v_updates GROUP BY article_id""",
            f"v_updates AS (SELECT {_numbered('(vec_id // 2) * 3')} AS article_id, embedding, vec_id FROM v_embeddings)",
        ),
        "redimension": _with(
            """SELECT id AS article_id, 'offline' AS model, 256 AS dim,
       (SELECT round(sum(v) / sqrt(sum(v * v)), 4) FROM (SELECT (i % 10) / 10.0 AS v FROM range(256) t(i)) s) AS total FROM v_articles"""
        ),
        "reduce_stored": _with(
            """SELECT article_id, 'leading-32' AS model, 32 AS dim, round(list_sum(list_transform(v, lambda x: x * x)), 5) AS norm2,
       round(v[32], 6) AS tail FROM v_short""",
            _reduced(32),
        ),
        "top_today": _with(f"{_TOP} WHERE v_articles.created_at BETWEEN {_DAY} AND {_AS_OF} ORDER BY quality_score DESC, v_articles.created_at DESC, id LIMIT 5"),
        "top_fallback": _with(f"{_TOP} ORDER BY quality_score DESC, v_articles.created_at DESC, id LIMIT 5"),
        "top_per_day": _with("SELECT CAST(day AS VARCHAR) AS day, CAST(rank AS INTEGER) AS rank, id, title, quality_score FROM v_ranked_days", _per_day(3)),
        "digest_html": _with(
            "SELECT CAST(day AS VARCHAR) AS digest_date, array_to_string(chunks, chr(10) || chr(10)) AS body FROM v_finished",
            *_chunked(_per_day(5)), recursive=True,
        ),
        "digest_md": _with(
            """SELECT CAST(day AS VARCHAR) AS digest_date, '# 🚀 Daily Digest' || chr(10) || '*' || strftime(day, '%A, %d %b %Y') || '*' || chr(10) || chr(10) ||
       string_agg('### ' || rank || '. [' || title || '](' || url || ')' || chr(10) || '**Quality Score:** ' || quality_score || '/10' ||
                  chr(10) || chr(10) || summary || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY rank) AS body
FROM v_ranked_days GROUP BY day""",
            _per_day(5),
        ),
        "digest_chunks": _with(_CHUNK_ROWS, *_chunked(_per_day(5)), recursive=True),
        "plain_text": f"SELECT page_id, {plain} AS plain FROM pages",
        "escape_quoted": f"SELECT page_id, {_escape('html')} AS escaped, {_escape('html', True)} AS quoted FROM pages",
        "truncate_text": f"WITH {_cut(8000)[0]}\nSELECT doc_id, cut FROM v_cut",
        "prompt_text": _with(
            "SELECT item_pos, CAST(length(prompt) AS INTEGER) AS size, prompt FROM v_prompts",
            *_prompts(),
        ),
        "split_text": """SELECT doc_id, CAST(i AS INTEGER) AS piece_no,
       CASE WHEN strlen(text) <= 3800 THEN text ELSE substring(text, CAST(i * 3800 + 1 AS INTEGER), 3800) END AS piece
FROM (SELECT doc_id, text, unnest(range(CASE WHEN strlen(text) <= 3800 THEN 1 ELSE (length(text) + 3799) // 3800 END)) AS i FROM documents) t""",
        "daily_run": _with(_CHUNK_ROWS, _PARSED, *_chunked(_RUN_RANKED), recursive=True),
        "daily_articles": _with(
            f"""SELECT {_uuid('url')} AS id, feed_id, title, url, clean AS raw_content, 8 AS quality_score,
       '2024-01-02 12:00:00' AS created_at FROM v_fresh""",
            _PARSED,
        ),
        "daily_vectors": _with(f"SELECT {_uuid('url')} AS article_id, 768 AS dim, '2024-01-02 12:00:00' AS created_at FROM v_fresh", _PARSED),
        "daily_rejected": _with(_REJECTED, _PARSED),
        "daily_counters": _with(
            """SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM v_fresh) AS new,
       (SELECT count(*) FROM v_readable WHERE feed_id IN (SELECT id FROM v_feeds WHERE is_active)) AS checked""",
            _PARSED,
        ),
        "daily_filtered": _with(
            f"""SELECT {_uuid('url')} AS id, feed_id, title, url, clean AS raw_content, 8 AS quality_score,
       '2024-01-02 12:00:00' AS created_at FROM v_fresh""",
            _PARSED,
        ),
        "unseen_by_filters": _with("SELECT DISTINCT url FROM v_items WHERE length(title) BETWEEN 1 AND 1024 AND url NOT IN (SELECT url FROM v_articles)"),
        "filter_days": _with("SELECT DISTINCT strftime(created_at, '%Y-%m-%d') AS day FROM v_articles"),
        "stream_ingest": _with(f"SELECT {_uuid('url')} AS id, url, 768 AS dim FROM v_fresh", _PARSED),
        "stream_rejected": _with(_REJECTED, _PARSED),
    }
    # the same rows, from tables and rankings that are kept
    same = {"keyed_lookup": "article_lookup", "keyed_delete_cascade": "feed_delete_cascade", "keyed_upsert": "embedding_upsert"}
    same |= {"top_today_kept": "top_today", "top_fallback_kept": "top_fallback"}
    return sql | {name: sql[as_] for name, as_ in same.items()}
