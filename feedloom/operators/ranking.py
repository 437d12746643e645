"""The best articles of a day, of all time, and of every day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import day_start
from feedloom.operators.joins import if_few

DEFAULT_TOP = 5
#: Articles of each day and write that a kept ranking holds.
KEPT = 50


def top_size(requested: int) -> int:
    return requested if requested > 0 else DEFAULT_TOP


def best_first() -> list[Column]:
    return [F.desc("quality_score"), F.desc("created_at"), F.asc("id")]


def fetch(articles: DataFrame, ids: list[str], micros: list[int]) -> DataFrame:
    """Whole rows of a bounded result by id and creation time (in microseconds).

    The filters are constants and reach the scan; a ``day`` partition column is
    used where the table has one.
    """
    times = [F.timestamp_micros(F.lit(m)) for m in sorted(set(micros))]
    rows = articles.where(F.col("id").isin(ids) & F.col("created_at").isin(times))
    if "day" in articles.columns:
        rows = rows.where(F.col("day").isin([F.to_date(t) for t in times]))
    return rows


def top_of_day(articles: DataFrame, as_of: Column, n: int = DEFAULT_TOP) -> DataFrame:
    """The day's best. The time filter reaches the scan; of a table partitioned by
    ``day`` only that day is read."""
    rows = articles.where((F.col("created_at") >= day_start(as_of)) & (F.col("created_at") <= as_of))
    if "day" in articles.columns:
        rows = rows.where(F.col("day") == F.to_date(as_of))
    return rows.orderBy(*best_first()).limit(top_size(n))


def top_or_latest(articles: DataFrame, as_of: Column, n: int = DEFAULT_TOP) -> DataFrame:
    """The day's best or, on a day without any, the best of all time.

    One narrow pass finds the ids: articles of the day sort first, and what the
    top-n holds of other days stays only if the day has none at all. The n rows
    are then fetched by id and time; on a table written in order of time the
    latter lets the reader skip nearly all of the wide columns.
    """
    today = F.col("created_at") >= day_start(as_of)
    best = (
        articles.where(F.col("created_at") <= as_of)
        .select("id", "quality_score", "created_at", today.alias("today"), F.unix_micros("created_at").alias("micros"))
        .orderBy(F.desc("today"), *best_first())
        .limit(top_size(n))
        .collect()
    )
    any_today = any(row["today"] for row in best)
    chosen = [row for row in best if row["today"] == any_today]
    return fetch(articles, [row["id"] for row in chosen], [row["micros"] for row in chosen]).orderBy(*best_first())


def top_per_day(articles: DataFrame, n: int = DEFAULT_TOP) -> DataFrame:
    """The ranking of every day of history. Ids, scores and times are ranked; the
    group limit runs before the shuffle, so a day with very many articles sends n
    rows per task. The rows themselves are fetched for the n of each day."""
    days = articles.select("id", "quality_score", "created_at", F.to_date("created_at").alias("day"))
    order = Window.partitionBy("day").orderBy(*best_first())
    best = days.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_size(n))
    kept = [c for c in articles.columns if c != "day"]
    return articles.select(kept).join(if_few(best.select("id", "created_at", "day", "rank")), ["id", "created_at"]).select(*kept, "day", "rank")


# A ranking that is kept: what the runs of a day found best, so that no later question scans the articles.


def best_of_days(articles: DataFrame, n: int) -> DataFrame:
    """(id, quality_score, created_at, day) of the ``n`` best of each day: one write's share of the kept ranking."""
    days = articles.select("id", "quality_score", "created_at", F.to_date("created_at").alias("day"))
    order = Window.partitionBy("day").orderBy(*best_first())
    return days.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def keep_ranking(articles: DataFrame, path: str, n: int = KEPT) -> None:
    """Adds the best of newly written articles, ``n`` a day. The parts of several writes to a day merge when they
    are read: the best of a union are among the best of its parts. Files are in order of the day, which is a column
    of them and makes no folders: a write may bring very many days."""
    best = best_of_days(articles, n).repartitionByRange("day", "id").sortWithinPartitions("day", *best_first())
    best.withColumn("kept", F.lit(n)).write.mode("append").parquet(path)


def _kept_best(kept: DataFrame, as_of: Column, n: int, days: Column) -> list | None:
    """The ``n`` best of some days up to ``as_of`` from the kept ranking; None if it holds too little to tell.

    A day of which it has seen articles later than ``as_of`` may have lost some that those displaced.
    """
    rows = kept.where(days)
    found = rows.where(F.col("created_at") <= as_of)
    best = found.select("id", F.unix_micros("created_at").alias("micros"), "quality_score", "created_at").orderBy(*best_first()).limit(n).collect()
    doubt = rows.agg(F.min("kept").alias("kept"), F.max(F.col("created_at") > as_of).alias("later")).first()
    if doubt["kept"] is not None and (doubt["later"] or doubt["kept"] < n):
        return None
    return best


def top_from_kept(articles: DataFrame, kept: DataFrame, as_of: Column, n: int = DEFAULT_TOP) -> DataFrame:
    """``top_or_latest`` from the kept ranking of all articles: reads the day's states, or those of every day
    if it has none, and the n rows. A question about the past, which the ranking has moved on from,
    or about more rows than are kept scans the articles."""
    size = top_size(n)
    today, earlier = F.col("day") == F.to_date(as_of), F.col("day") <= F.to_date(as_of)
    for days in (today, earlier):
        best = _kept_best(kept, as_of, size, days)
        if best is None:
            return top_or_latest(articles, as_of, n)
        if best:
            break
    return fetch(articles, [r["id"] for r in best], [r["micros"] for r in best]).orderBy(*best_first())
