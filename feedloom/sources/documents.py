"""Raw feed documents (RSS 0.9x/2.0, RSS 1.0, Atom, JSON Feed) to entries.

Downloading is not done here: the input is a table of bodies, one row per fetch.
One schema holds the elements of every XML dialect, so a body is parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.binding import computed_once
from feedloom.functions.text import SPACES, parse_feed_date, strip_html, trim_space

_S = T.StringType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


_LINK = _struct(_VALUE=_S, _href=_S, _rel=_S)
_RSS_ITEM = T.StructType([
    T.StructField("title", _S),
    T.StructField("link", T.ArrayType(_LINK)),
    T.StructField("description", _S),
    T.StructField("content:encoded", _S),
    T.StructField("pubDate", _S),
    T.StructField("dc:date", _S),
])
_ATOM_ENTRY = T.StructType([
    # as text, which keeps the markup inside an element of type xhtml
    T.StructField("title", _S),
    T.StructField("link", T.ArrayType(_LINK)),
    T.StructField("content", _S),
    T.StructField("summary", _S),
    T.StructField("published", _S),
    T.StructField("updated", _S),
])
_XML = T.StructType([
    T.StructField("channel", T.StructType([T.StructField("title", _S), T.StructField("item", T.ArrayType(_RSS_ITEM))])),
    T.StructField("item", T.ArrayType(_RSS_ITEM)),  # RSS 1.0 keeps its items beside the channel
    T.StructField("title", _S),
    T.StructField("entry", T.ArrayType(_ATOM_ENTRY)),
    T.StructField("_broken", _S),
])
_JSON = _struct(
    version=_S,
    title=_S,
    items=T.ArrayType(
        _struct(
            title=_S, url=_S, content_html=_S, content_text=_S, summary=_S, date_published=_S, date_modified=_S
        )
    ),
    _broken=_S,
)

_ENTRY = _struct(title=_S, link=_S, content=_S, description=_S, published=_S, updated=_S)


def _alternate(links: Column) -> Column:
    """The link meant for readers: rel="alternate", which is also the default."""
    return F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]


def _plain_link(links: Column) -> Column:
    return F.get(F.filter(links, lambda x: x["_VALUE"].isNotNull()), F.lit(0))["_VALUE"]


def _plain_title(title: Column) -> Column:
    """A title of type xhtml is a division; its markup is left out."""
    return F.when(title.rlike(r"(?s)^\s*<(?:\w+:)?div[\s>]"), strip_html(title)).otherwise(title)


def _entry(**columns: Column) -> Column:
    return F.struct(*[columns[name].alias(name) for name in _ENTRY.fieldNames()])


def _rss(items: Column) -> Column:
    return F.transform(
        items,
        lambda i: _entry(
            title=i["title"],
            link=_plain_link(i["link"]),
            content=i["content:encoded"],
            description=i["description"],
            published=F.coalesce(i["pubDate"], i["dc:date"]),
            updated=i["dc:date"],
        ),
    )


def _atom(entries: Column) -> Column:
    return F.transform(
        entries,
        lambda e: _entry(
            title=_plain_title(e["title"]),
            link=_alternate(e["link"]),
            content=e["content"],
            description=e["summary"],
            published=e["published"],
            updated=e["updated"],
        ),
    )


def _json(items: Column) -> Column:
    return F.transform(
        items,
        lambda i: _entry(
            title=i["title"],
            link=i["url"],
            content=F.coalesce(i["content_html"], i["content_text"]),
            description=i["summary"],
            published=i["date_published"],
            updated=i["date_modified"],
        ),
    )


def _plain_ampersands(body: Column) -> Column:
    """Ampersands that start no XML entity become text, as lenient readers take
    them: bare ones, and HTML entities. What is marked as CDATA stays."""
    parts = F.split(body, r"(?=<!\[CDATA\[)|(?<=\]\]>)")
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(p.startswith("<![CDATA["), p).otherwise(
                F.regexp_replace(p, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")
            ),
        ),
        "",
    )


def parse(raw_feeds: DataFrame) -> DataFrame:
    """Adds ``feed_title``, ``entries`` (array) and ``readable``; drops the body.

    A body is readable when it is well formed, loose ampersands aside, and has the
    root of a known dialect.
    """
    body = F.ltrim(F.col("body"), F.lit("\ufeff" + SPACES))
    # XML is the only dialect that starts with "<"; the parser is not run on others.
    is_xml = F.col("_body").startswith("<")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    first = computed_once(
        raw_feeds.withColumn("_body", body),
        _first=F.from_xml(F.when(is_xml, F.col("_body")), _XML.json(), options),
        _json=F.from_json(F.when(~is_xml, F.col("_body")), _JSON, options),
    )
    second = F.from_xml(_plain_ampersands(F.col("_body")), _XML.json(), options)
    broken = F.col("_first._broken").isNotNull() & F.col("_body").contains("&")
    parsed = computed_once(first, _xml=F.when(broken, second).otherwise(F.col("_first")))
    x, j = F.col("_xml"), F.col("_json")
    no_rss = F.array().cast(_XML["item"].dataType)
    no_json = F.array().cast(_JSON["items"].dataType)
    found = (
        F.when(x["_broken"].isNotNull(), None)
        .when(x["entry"].isNotNull(), _atom(x["entry"]))
        .when(x["channel"]["item"].isNotNull(), _rss(x["channel"]["item"]))
        .when(x["channel"].isNotNull(), _rss(F.coalesce(x["item"], no_rss)))
        .when(x["title"].isNotNull(), F.array().cast(T.ArrayType(_ENTRY)))
        .when(j["_broken"].isNull() & j["version"].isNotNull(), _json(F.coalesce(j["items"], no_json)))
    )
    title = trim_space(F.coalesce(x["channel"]["title"], _plain_title(x["title"]), j["title"]))
    return (
        computed_once(parsed, entries=found)
        .withColumn("readable", F.col("entries").isNotNull())
        .withColumn("feed_title", F.when(F.col("readable"), title))
        .drop("_first", "_xml", "_json", "_body", "body")
    )


def feed_titles(raw_feeds: DataFrame) -> DataFrame:
    """What each readable document calls itself."""
    return parse(raw_feeds).where("readable").select("feed_id", "fetched_at", F.coalesce("feed_title", F.lit("")).alias("title"))


def unreadable(raw_feeds: DataFrame) -> DataFrame:
    return parse(raw_feeds).where("NOT readable").drop("entries", "feed_title", "readable").withColumn("reason", F.lit("unreadable"))


def entries(raw_feeds: DataFrame, keep_unreadable: bool = False) -> DataFrame:
    """One row per entry of each readable document, positions from 0. On request also
    one row without a position for each document that cannot be read."""
    rows = parse(raw_feeds).drop("feed_title")
    kept = [c for c in rows.columns if c not in ("entries", "readable")]
    if keep_unreadable:
        flat = rows.select(*kept, "readable", F.posexplode_outer("entries").alias("item_pos", "entry"))
        flat = flat.where("item_pos IS NOT NULL OR NOT readable")
    else:
        flat = rows.select(*kept, F.posexplode("entries").alias("item_pos", "entry"))
    return flat.select(
        *kept,
        F.col("item_pos").cast("long").alias("item_pos"),
        "entry.title",
        "entry.link",
        "entry.content",
        "entry.description",
        parse_feed_date(F.col("entry.published")).alias("published"),
        parse_feed_date(F.col("entry.updated")).alias("updated"),
    )
