"""Small tables written by hand."""

import datetime

from feedloom import schemas as S
from feedloom.plans.sample_tables import numbered_id  # noqa: F401

DAY = datetime.datetime(2024, 1, 2)


def fid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def at(day=2, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def feeds(spark, *rows):
    """(number, url, name, active)"""
    return spark.createDataFrame([(fid(n), u, name, on, at(1, n % 24), at(1)) for n, u, name, on in rows], S.FEEDS)


def articles(spark, *rows):
    """(number, feed number, url, score, created)"""
    data = [(fid(n), fid(f), f"t{n}", u, "raw", f"summary {n}", q, None, c) for n, f, u, q, c in rows]
    return spark.createDataFrame(data, S.ARTICLES)


def vectors(spark, *rows):
    """(article number, values, created)"""
    return spark.createDataFrame([(fid(n), [float(x) for x in v], c) for n, v, c in rows], S.EMBEDDINGS)


def raw(spark, *rows):
    """(feed number, hour of the fetch, body)"""
    return spark.createDataFrame([(fid(f), at(2, h), b) for f, h, b in rows], S.RAW_FEEDS)


def rss(*items, title="Feed"):
    """items: (title, link, content)"""
    body = "".join(f"<item><title>{t}</title><link>{u}</link><description>{c}</description></item>" for t, u, c in items)
    return f'<rss version="2.0"><channel><title>{title}</title>{body}</channel></rss>'
