"""Which stored partitions may hold a URL: membership filters kept beside the articles.

Every write of articles also writes a filter for each of its partitions (days, or batches of a stream). A
filter is a table of 64-bit words: a URL sets four bits in each of two words, all picked by hashes of it, and a
partition of n URLs has a power of two of words, n/2 at least. One of few URLs has very many words, of which only those with a bit
are rows, two for a URL: a look-up then meets few of the small partitions, however many there are. Filters are built by one aggregation
(``bit_or``), begun before the shuffle, and later writes to the same partition just add rows.

A look-up scans the words, 4 to 8 bytes for a stored URL, instead of the URLs, and names the partitions that
may hold one of those asked for; a partition without it is named once in some 40,000 cases. Only the named
partitions are then read, so answers are exact and the days that nothing points to are not touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.operators.joins import few, if_few
from feedloom.operators.ingest import unseen
from feedloom.session import staged

#: Partitions of up to so many URLs have ``MANY_WORDS`` words.
FEW_URLS = 512
MANY_WORDS = 1 << 20
#: Partitions that a scan is given as a list of constants; more are joined.
LISTED = 1000
_BITS = 4


def _mask(url: Column, half: int) -> Column:
    """Four of 64 bits, from four groups of six bits of a hash."""
    source = F.xxhash64(url, F.lit("bits"))
    picks = [F.shiftright(source, 6 * (_BITS * half + i)).bitwiseAND(F.lit(63)).cast("int") for i in range(_BITS)]
    # shiftleft by a column is SQL's
    return reduce(lambda a, b: a.bitwiseOR(b), [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in picks])


def _probe(url: Column, words: Column, half: int) -> Column:
    place = F.pmod(F.xxhash64(url, F.lit(f"word {half}")), words.cast("long")).cast("int")
    return F.struct(F.lit(half).alias("half"), place.alias("word"), _mask(url, half).alias("mask"))


def _probes(url: Column, words: Column) -> Column:
    return F.explode(F.array(*[_probe(url, words, half) for half in (0, 1)]))


def filters_of(articles: DataFrame, part: str = "day") -> DataFrame:
    """(part, words, word, bits) of articles that are written together."""
    sizes = articles.groupBy(part).agg(F.count("*").alias("n"))
    power = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / 2, F.lit(1.0)))))
    sizes = sizes.select(part, F.when(F.col("n") <= FEW_URLS, MANY_WORDS).otherwise(power).cast("int").alias("words"))
    probed = articles.select(part, "url").join(if_few(sizes), part).select(part, "words", _probes(F.col("url"), F.col("words")).alias("p"))
    return probed.groupBy(part, "words", F.col("p.word").alias("word")).agg(F.bit_or("p.mask").alias("bits"))


def write_filters(articles: DataFrame, path: str, part: str = "day", mode: str = "append") -> None:
    """To be called with the articles of one write, after it."""
    cut = filters_of(articles, part).repartitionByRange(part, "words", "word").sortWithinPartitions(part, "words", "word")
    cut.write.mode(mode).parquet(path)


def parts_with(urls: DataFrame, filters: DataFrame, part: str = "day") -> DataFrame:
    """The partitions that may hold one of the urls. ``urls`` is read twice: stage costly ones."""
    sizes = sorted(r["words"] for r in filters.select("words").distinct().collect())  # powers of two
    if not sizes:
        return filters.select(part).distinct()
    asked = urls.select("url", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("words"))
    asked = asked.select(F.xxhash64("url").alias("key"), "words", _probes(F.col("url"), F.col("words")).alias("p"))
    asked = asked.select("key", "words", "p.half", "p.word", "p.mask").distinct()
    found = filters.join(if_few(asked), ["words", "word"]).where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    both = found.groupBy(part, "words", "key").agg((F.max("half") - F.min("half")).alias("halves"))
    return both.where("halves = 1").select(part).distinct()


def named_parts(urls: DataFrame, filters: DataFrame, part: str = "day") -> list:
    """``parts_with``, on the driver: at most one value for each partition of the articles."""
    return sorted(r[part] for r in parts_with(urls, filters, part).collect())


def unseen_by_filters(items: DataFrame, articles: DataFrame, filters: DataFrame, part: str = "day") -> DataFrame:
    """Items (or places), written to a table, whose URL is not stored. ``articles`` has ``part`` as a
    partition column, and each of its URLs is in ``filters``. A backfill reads everything."""
    urls = items.select("url").distinct()
    if not few(urls):
        return unseen(items, articles)
    urls = staged(urls, "asked-urls")
    named = staged(parts_with(urls, filters, part), "named-parts")
    if named.count() > LISTED:
        near = articles.join(if_few(named), part, "left_semi")
    else:
        near = articles.where(F.col(part).isin(sorted(r[part] for r in named.collect())))
    known = near.select("url").join(F.broadcast(urls), "url", "left_semi").distinct()
    return items.join(F.broadcast(known), "url", "left_anti").select(items.columns)
