"""DuckDB SQL of the queries that SQL can express. Constants are written out here, not imported."""

from feedloom.llm import license_rules

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang FROM documents),
w AS (SELECT doc_id, t, lang, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
step AS (SELECT *, regexp_replace(t, '\p{Ll}+', '', 'g') AS r0 FROM w),
step1 AS (SELECT *, regexp_replace(r0, '[\x20\x09-\x0D]+', '', 'g') AS r1 FROM step),
step2 AS (SELECT *, regexp_replace(r1, '\p{Lu}+', '', 'g') AS r2 FROM step1),
step3 AS (SELECT *, regexp_replace(r2, '\p{L}+', '', 'g') AS r3 FROM step2),
step4 AS (SELECT *, regexp_replace(r3, '[.,;:!?''\x22()-]+', '', 'g') AS r4 FROM step3),
step5 AS (SELECT *, regexp_replace(r4, '\p{Nd}+', '', 'g') AS r5 FROM step4),
c AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, t, ws,
    [length(t) - length(r0), length(r0) - length(r1), length(r1) - length(r2), length(r2) - length(r3),
     length(r3) - length(r4), length(r4) - length(r5), length(r5)] AS cs,
    list_transform(list_filter(ws, lambda x: length(x) <= 4), lambda x: lower(x)) AS short
  FROM step5),
ref_chars AS (
  SELECT lang, list(share ORDER BY k) AS classes FROM (
    SELECT lang, k, sum(n) / greatest(sum(sum(n)) OVER (PARTITION BY lang), 1) AS share
    FROM (SELECT lang, unnest(cs) AS n, unnest(range(1, 8)) AS k FROM c) GROUP BY lang, k) GROUP BY lang),
ref_words AS (
  SELECT lang, word, n / sum(n) OVER (PARTITION BY lang) AS share,
    row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place
  FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(short) AS word FROM c) GROUP BY lang, word)),
top AS (SELECT * FROM ref_words WHERE place <= 24),
top_sum AS (SELECT lang, sum(share) AS s FROM top GROUP BY lang),
own AS (
  SELECT rid, b.lang, coalesce(top.word, '') AS bin, coalesce(any_value(top.share), any_value(1 - top_sum.s)) AS q, count(*) AS n
  FROM (SELECT rid, lang, unnest(short) AS word FROM c) b
  JOIN top_sum ON top_sum.lang IS NOT DISTINCT FROM b.lang
  LEFT JOIN top ON top.lang IS NOT DISTINCT FROM b.lang AND top.word = b.word GROUP BY ALL),
word_d AS (
  SELECT rid, sum(n) AS n, 0.5 + sum(0.5 * p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END - 0.5 * q) AS js
  FROM (SELECT rid, q, n, n / sum(n) OVER (PARTITION BY rid) AS p FROM own) GROUP BY rid),
char_d AS (
  SELECT rid, sum(CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END) AS js
  FROM (SELECT rid, unnest(cs) / length(t) AS p, unnest(classes) AS q FROM c JOIN ref_chars ON ref_chars.lang IS NOT DISTINCT FROM c.lang WHERE t <> '') GROUP BY rid),
windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM c WHERE len(ws) > 5)),
repeated AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (
    SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (
      SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS m FROM windows) WHERE m > 1) GROUP BY rid),
m AS (
  SELECT c.doc_id, len(ws)::BIGINT AS n_words, (length(t) - cs[2])::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
     - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    length(t) >= 200 AND sqrt(greatest(coalesce(char_d.js, 0), 0)) > 0.28 AS strange,
    coalesce(word_d.n, 0) >= 40 AND sqrt(greatest(coalesce(word_d.js, 0), 0)) > 0.80 AS odd
  FROM c LEFT JOIN repeated USING (rid) LEFT JOIN char_d USING (rid) LEFT JOIN word_d USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR strange OR odd) AS kept
FROM m
"""


DEDUP = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


LICENSES = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, ' ' || trim(lower(regexp_replace(coalesce(text, ''), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', '  ', 'g')), ' ') || ' ' AS norm
  FROM documents),
phrase AS (FROM (VALUES (' mit  license ', 'mit'), (' apache  license ', 'apache'), (' general  public  license ', 'gpl')) v(p, label)),
cut AS (SELECT rid, label, p, string_split(norm, p) AS gaps FROM d JOIN phrase ON contains(norm, p)),
place AS (
  SELECT rid, label, k, sum(length(gaps[k]) - length(replace(gaps[k], ' ', ''))) OVER (PARTITION BY rid, label ORDER BY k) AS gap_spaces,
    (length(p) - length(replace(p, ' ', ''))) * (k - 1) AS own_spaces
  FROM (SELECT *, unnest(range(1, len(gaps))) AS k FROM cut)),
base AS (
  SELECT rid, count(*) AS n, min((gap_spaces + own_spaces) // 2)::BIGINT AS a, max((gap_spaces + own_spaces) // 2)::BIGINT AS b, list(DISTINCT label) AS ls
  FROM place GROUP BY rid),
rule AS (FROM (VALUES {rules}) v(rank, level, label, gate, pattern, weight)),
likely AS (SELECT * FROM d WHERE regexp_matches(norm, 'licen| under | hereby | fee | redistribution | origin | unencumbered | domain | rights | spdx | software | agreement | redistributions ')),
hit AS (
  SELECT rid, rule.*, regexp_extract_all(norm, pattern) AS ms, string_split_regex(norm, pattern) AS gaps
  FROM likely JOIN rule ON contains(norm, gate)),
span AS (
  SELECT rid, rank, level, label, weight, ends - length(ms[k]) AS s, ends AS e FROM (
    SELECT *, sum(length(gaps[k]) + length(ms[k])) OVER (PARTITION BY rid, rank ORDER BY k) AS ends
    FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM hit WHERE len(ms) > 0))),
left_ AS (
  SELECT x.* FROM span x WHERE NOT EXISTS (
    SELECT 1 FROM span y WHERE y.rid = x.rid AND y.s <= x.s AND y.e >= x.e AND y.level <= x.level
      AND (y.s < x.s OR y.e > x.e OR y.level < x.level OR y.rank < x.rank))),
own AS (SELECT rid, list(DISTINCT label) AS ls, max(weight) AS w FROM left_ GROUP BY rid)
SELECT doc_id, CASE WHEN norm = '  ' THEN 0 ELSE (length(norm) - length(replace(norm, ' ', ''))) // 2 END::BIGINT AS n_words,
  coalesce(base.n, 0)::BIGINT AS n_base, base.a AS first_word, base.b AS last_word,
  coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(own.ls, [])))), ','), '') AS labels,
  coalesce(own.w, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN own USING (rid)
"""


def _license_values() -> str:
    # the signature table itself; the matching is written anew above
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = enumerate(license_rules.rules())
    return ", ".join(f"({k}, {r.level}, {quoted(r.label)}, {quoted(f' {r.keyword} ')}, {quoted(license_rules.spaced(r.pattern))}, {r.weight})" for k, r in rows)


URLS = r"""
WITH u AS (
  SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT rid, page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (
  SELECT *, CASE
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    string_split(host, '.') AS ls, string_split(path, '/') AS ps, string_split_regex(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '[&;]') AS asked FROM h),
n AS (
  SELECT *, CASE WHEN len(ls) > 2 THEN ls[1:len(ls) - 2] ELSE [] END AS own, list_transform(asked, lambda p: split_part(p, '=', 1)) AS names,
    list_transform(asked, lambda p: regexp_extract(p, '=(.*)', 1)) AS vals FROM l),
t AS (
  SELECT *, CASE WHEN host = '' THEN [] ELSE list_sort(list_distinct(list_transform(list_filter(list_concat(
      [CASE WHEN starts_with(url, 'https:') THEN 'scheme:https' ELSE 'scheme:other' END, 'top:' || ls[-1],
       CASE WHEN len(ls) >= 2 THEN 'domain:' || ls[-2] || '.' || ls[-1] END, 'ending:' || regexp_extract(path, '\.([A-Za-z]+)$', 1),
       CASE WHEN contains(url, '?') THEN 'query' END, CASE WHEN contains(url, '#') THEN 'anchor' END],
      list_transform(own, lambda x: 'name:' || x), list_transform(ps, lambda x: 'part:' || x),
      list_transform(names, lambda x: 'asks:' || x), list_transform(vals, lambda x: 'value:' || x),
      list_transform(flatten(list_filter(list_transform(list_concat(ls, ps, names, vals),
        lambda x: string_split_regex(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+')), lambda w: len(w) > 1)), lambda x: 'word:' || x)),
    lambda x: x IS NOT NULL AND NOT regexp_matches(x, '^[a-z]+:$')), lambda x: regexp_replace(x, '[ \t\n\v\f\r]', '+', 'g')))) END AS items FROM n),
g AS (SELECT doc_id AS page_id, max(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
tx AS MATERIALIZED (SELECT row_number() OVER () AS tid, items, bad FROM t JOIN g USING (page_id)),
c AS MATERIALIZED (SELECT count(*) AS n, coalesce(sum(bad::INT), 0) AS nb, greatest(5, ceil(count(*) * 0.002)) AS least, coalesce(sum(bad::INT), 0)::DOUBLE / count(*) AS p FROM tx),
single AS MATERIALIZED (
  SELECT item, count(*) AS n, sum(bad::INT) AS nb, list(tid ORDER BY tid) AS tids FROM (SELECT tid, unnest(items) AS item, bad FROM tx)
  GROUP BY item HAVING sum(bad::INT) >= (SELECT least FROM c) AND (SELECT nb >= 5 AND 1.2 * nb <= n FROM c)),
same AS MATERIALIZED (
  SELECT min(item) AS item, list(item) AS members, round((any_value(nb) - any_value(n) * any_value(p)) / sqrt(any_value(n) * (any_value(p) * (1 - any_value(p)))), 9) AS telling
  FROM (SELECT single.*, c.p FROM single, c) GROUP BY tids),
fit AS (
  SELECT tid, bad, list_sort(list(item)) AS items FROM (
    SELECT tid, bad, item, row_number() OVER (PARTITION BY tid ORDER BY telling DESC, item) AS place
    FROM (SELECT tid, bad, unnest(items) AS item FROM tx) JOIN same USING (item)) WHERE place <= 8 GROUP BY tid, bad),
kind AS (SELECT items, count(*) AS n, sum(bad::INT) AS nb FROM fit GROUP BY items),
subset AS (
  SELECT list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS ante, n, nb
  FROM (SELECT *, unnest(range(1, 1 << len(items))) AS mask FROM kind)),
found AS (
  SELECT ante FROM (SELECT ante, sum(n) AS n, sum(nb) AS nb FROM subset GROUP BY ante), (SELECT nb / n AS p, least FROM c)
  WHERE nb >= least AND nb / n >= 0.5 AND nb / n >= 1.2 * p AND round((nb - n * p) / sqrt(n * (p * (1 - p))), 9) >= 3.1),
r AS (SELECT ante, list_distinct(flatten(list(members))) AS whole FROM (SELECT ante, unnest(ante) AS item FROM found) JOIN same USING (item) GROUP BY ante)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN EXISTS (SELECT 1 FROM r WHERE list_has_all(t.items, r.whole)) THEN 'block' ELSE 'allow' END AS verdict
FROM t
"""


SEARCH = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
c AS (SELECT count(*)::BIGINT AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), c),
m AS (SELECT rid, doc_id, 100 - 90 + (90 * len(ts)::BIGINT * n) // l AS m FROM d, c WHERE len(ts) > 0),
s AS (
  SELECT item_id, rid, m.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item_id, rid, m.doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""


CLUSTERS = """
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS y FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM k ORDER BY h, x LIMIT 40)),
{rounds}
last AS MATERIALIZED ({last})
SELECT vec_id, last.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY last.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(y, ',')) AS centroid_sha256
FROM last JOIN c5 ON last.c = c5.c
"""

_NEAREST = """SELECT rid, vec_id, x, c, d FROM (
    SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, c) AS place FROM (
      SELECT rid, vec_id, x, c, list_sum(list_transform(range(1, 65), lambda j: (x[j] - y[j]) * (x[j] - y[j])))::BIGINT AS d FROM k, {c}))
  WHERE place = 1"""

_ROUND = """a{k} AS MATERIALIZED ({nearest}),
m{k} AS (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS y FROM (
    SELECT c, j, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT c, unnest(x) AS v, unnest(range(1, 65)) AS j FROM a{k}) GROUP BY c, j) GROUP BY c),
c{n} AS MATERIALIZED (SELECT c, coalesce(m{k}.y, c{k}.y) AS y FROM c{k} LEFT JOIN m{k} USING (c)),"""


def _cluster_sql() -> str:
    rounds = "\n".join(_ROUND.format(k=k, n=k + 1, nearest=_NEAREST.format(c=f"c{k}")) for k in range(5))
    return CLUSTERS.format(rounds=rounds, last=_NEAREST.format(c="c5"))


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": DEDUP,
        "op4_url_filter": URLS,
        "op6_license_scan": LICENSES.replace("{rules}", _license_values()),
        "op10_quality_rules": QUALITY,
        "op12_lexical_search": SEARCH,
        "op13_clustering": _cluster_sql(),
    }
