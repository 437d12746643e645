"""Validation rules. Each error function gives a reason, or null when the row is good."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom import schemas as S
from feedloom.functions.text import is_blank, trim_space

DEFAULT_HITS = 5
MAX_HITS = 50

_HOST_AND_PORT = r"^(?:\[[0-9A-Za-z:.%]*\]|[^\x00-\x20\x7f\\^`{|}#@:\[\]]*)(?::\d*)?$"


def is_http_uri(url: Column) -> Column:
    """An absolute http(s) URI: no control characters, whole percent escapes in
    the path, no delimiter in the host, a numeric port. Plain character loops
    only: a regex that loops over alternatives overflows the stack on long input.
    """
    before_query = F.substring_index(url, "?", 1)
    authority = F.regexp_extract(before_query, r"(?is)^https?://([^/]*)", 1)
    host = F.regexp_replace(authority, r"(?s)^.*@", "")
    path = F.regexp_replace(before_query, r"(?is)^https?:(?://[^/]*)?", "")
    opaque = url.rlike(r"(?i)^https?:(?!/)")
    whole = ~path.rlike("%(?![0-9A-Fa-f]{2})") & ~host.rlike("%(?!25|[89A-Fa-f][0-9A-Fa-f])")
    return url.rlike("(?i)^https?:") & ~url.rlike(r"[\x00-\x1f\x7f]") & (opaque | (whole & host.rlike(_HOST_AND_PORT)))


def feed_name(given: Column, discovered: Column, url: Column) -> Column:
    """The given name, else the document's own title, else the URL; trimmed last,
    so that a title of nothing but white space leaves no name at all."""
    return trim_space(F.coalesce(F.nullif(trim_space(given), F.lit("")), F.nullif(discovered, F.lit("")), url))


def feed_error(url: Column, name: Column) -> Column:
    clean = trim_space(url)
    return (
        F.when(is_blank(name), "empty_name")
        .when(~F.coalesce(is_http_uri(clean), F.lit(False)), "invalid_url")
        .when(F.length(clean) > S.MAX_URL, "url_too_long")
        .when(F.length(trim_space(name)) > S.MAX_FEED_NAME, "name_too_long")
    )


def item_error(title: Column, url: Column) -> Column:
    """What can be known about an article before it is summarised."""
    return (
        F.when(is_blank(title), "empty_title")
        .when(is_blank(url), "empty_url")
        .when(F.length(trim_space(title)) > S.MAX_TITLE, "title_too_long")
        .when(F.length(trim_space(url)) > S.MAX_URL, "url_too_long")
    )


def article_error(title: Column, url: Column, score: Column) -> Column:
    bad_score = ~F.coalesce(score.between(S.MIN_SCORE, S.MAX_SCORE), F.lit(False))
    return (
        F.when(is_blank(title), "empty_title")
        .when(is_blank(url), "empty_url")
        .when(bad_score, "invalid_score")
        .otherwise(item_error(title, url))
    )


def clamp_score(score: Column) -> Column:
    return F.least(F.lit(S.MAX_SCORE), F.greatest(F.lit(S.MIN_SCORE), F.coalesce(score, F.lit(0)))).cast("int")


def hit_limit(requested) -> int:
    """The number of hits for one request: a number, or a text of ASCII digits with
    a sign at most that fits 64 bits. Anything else counts as not given."""
    if isinstance(requested, str):
        requested = int(requested) if re.fullmatch("[+-]?[0-9]+", requested) else 0
    value = requested if isinstance(requested, int) and not isinstance(requested, bool) else 0
    return min(MAX_HITS, value) if 0 < value < 1 << 63 else DEFAULT_HITS


def hit_limit_of_text(requested: Column) -> Column:
    """``hit_limit`` for a column of texts."""
    value = F.when(requested.rlike(r"\A[+-]?[0-9]+\z"), requested.try_cast("bigint"))
    return hit_limit_column(value)


def hit_limit_column(requested: Column) -> Column:
    return F.least(F.lit(MAX_HITS), F.when(requested > 0, requested).otherwise(F.lit(DEFAULT_HITS))).cast("int")


def clean_query(text: str | None) -> str:
    clean = (text or "").strip()
    if not clean:
        raise ValueError("search query cannot be empty")
    return clean


def query_error(text: Column) -> Column:
    return F.when(is_blank(text), "empty_query")
