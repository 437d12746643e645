from feedloom.operators import ingest
from feedloom.sources import documents
from tests.tables import fid, raw, rss

ATOM = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom feed</title>
<entry><title type="html">One</title><link rel="self" href="https://self"/><link rel="alternate" href="https://one"/>
<content type="html">&lt;p&gt;full&lt;/p&gt;</content><summary>short</summary>
<published>2024-01-02T03:04:05Z</published><updated>2024-01-03T00:00:00Z</updated></entry>
<entry><title>Two</title><link href="https://two"/><summary>only short</summary><updated>2024-01-03T00:00:00Z</updated></entry>
<entry><title>No alternate</title><link rel="self" href="https://self"/></entry></feed>"""
FULL = """<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title> Full </title>
<link>https://site</link>
<item><title> A &amp; B </title><link> https://a </link><description>short</description>
<content:encoded><![CDATA[<p>long &amp; <b>full</b></p>]]></content:encoded><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>
<item><title>blank content</title><link>https://b</link><description>used</description><content:encoded> </content:encoded></item>
<item><title>blank link</title><link>  </link></item></channel></rss>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">
<channel><title>Old</title></channel><item><title>R</title><link>https://r</link><description>d</description><dc:date>2024-01-02</dc:date></item></rdf:RDF>"""
JSON = """ {"version": "https://jsonfeed.org/version/1.1", "title": "J", "items": [
{"title": "T", "url": "https://j", "content_text": "text", "summary": "s", "date_modified": "2024-01-04T00:00:00Z"}]}"""
SINGLE = rss(("Only", "https://only", "x"))


def items(spark, *bodies):
    rows = ingest.normalise_items(documents.entries(raw(spark, *[(i, i, b) for i, b in enumerate(bodies)])))
    return {
        r.url: (r.item_pos, r.title, r.content, str(r.published_at) if r.published_at else None)
        for r in rows.orderBy("feed_id", "item_pos").collect()
    }


def test_every_dialect(spark):
    assert items(spark, ATOM, FULL, RDF, JSON, SINGLE) == {
        "https://one": (0, "One", "full", "2024-01-02 03:04:05"),
        "https://two": (1, "Two", "only short", "2024-01-03 00:00:00"),
        "https://a": (0, "A & B", "long &amp; full", "2024-01-02 03:04:05"),
        "https://b": (1, "blank content", "used", None),
        "https://r": (0, "R", "d", "2024-01-02 00:00:00"),
        "https://j": (0, "T", "text", "2024-01-04 00:00:00"),
        "https://only": (0, "Only", "x", None),
    }


def test_unreadable_bodies_are_reported_and_skipped(spark):
    bodies = [ATOM, FULL[:-12], "", "plain words", "<html><body>x</body></html>", "{}", "[1", None, JSON[:-3], SINGLE]
    rows = raw(spark, *[(i, i, b or "") for i, b in enumerate(bodies)])
    lost = {r.feed_id for r in documents.unreadable(rows).collect()}
    assert lost == {fid(i) for i in range(1, 9)}
    assert {r.feed_id for r in documents.entries(rows).collect()} == {fid(0), fid(9)}


def test_titles(spark):
    rows = raw(spark, (0, 0, ATOM), (1, 0, FULL), (2, 0, RDF), (3, 0, JSON), (4, 0, "nothing"), (5, 0, rss(title="")))
    got = {r.feed_id: r.title for r in documents.feed_titles(rows).collect()}
    assert got == {fid(0): "Atom feed", fid(1): "Full", fid(2): "Old", fid(3): "J", fid(5): ""}


def test_a_feed_without_items_is_readable(spark):
    rows = raw(spark, (0, 0, rss(title="Empty")), (1, 0, '<feed xmlns="http://www.w3.org/2005/Atom"><title>E</title></feed>'))
    assert documents.unreadable(rows).isEmpty() and documents.entries(rows).isEmpty()


def test_loose_ampersands_and_leading_marks(spark):
    loose = rss(("Q&nbsp;&amp; A & B", "https://u?a=1&b=2", "<![CDATA[x & <b>y</b> &nbsp;]]> &eacute;"))
    marked = "\ufeff \n" + rss(("T", "https://marked", "x"))
    assert items(spark, loose, marked) == {
        "https://u?a=1&b=2": (0, "Q&nbsp;& A & B", "x & y &nbsp; &eacute;", None),
        "https://marked": (0, "T", "x", None),
    }
    still_broken = rss(("a & b", "https://u", "x"))[:-4]
    assert documents.unreadable(raw(spark, (0, 0, still_broken))).count() == 1


XHTML = """<feed xmlns="http://www.w3.org/2005/Atom"><title type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml">The <i>feed</i></div></title>
<entry><title type="xhtml">
  <div xmlns="http://www.w3.org/1999/xhtml">A <b>bold</b> title</div></title><link href="https://x"/>
<content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>One &amp; two.</p><p>Three.</p></div></content>
<summary>short</summary><updated>2024-01-03T00:00:00Z</updated></entry>
<entry><title>a &lt;b&gt; c</title><link href="https://y"/><content type="html">&lt;p&gt;x&lt;/p&gt;</content></entry></feed>"""


def test_xhtml_keeps_its_text(spark):
    found = items(spark, XHTML)
    assert found["https://x"][1] == "A bold title" and found["https://x"][2].startswith("One ") and "Three." in found["https://x"][2]
    assert found["https://y"][1:3] == ("a <b> c", "x")
    assert documents.feed_titles(raw(spark, (1, 1, XHTML))).first().title == "The feed"
