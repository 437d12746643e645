import datetime
import random

from pyspark.sql import functions as F

from feedloom.functions import render
from feedloom.operators import digest

DAY = datetime.datetime(2026, 9, 9)
ARTICLES = "articles array<struct<title string, url string, quality_score int, summary string>>"
STYLE = render.Style()
HEADER = "🚀 <b>DAILY DIGEST</b>\n<i>Wednesday, 09 Sep 2026</i>\n\n"


def digests(spark, *groups):
    return spark.createDataFrame([(i, DAY, g) for i, g in enumerate(groups)], f"i int, day timestamp, {ARTICLES}")


def rendered(spark, build, *groups, style=STYLE):
    rows = digests(spark, *groups).select("i", build(F.col("day"), F.col("articles"), style).alias("out"))
    return [r.out for r in rows.orderBy("i").collect()]


def escape(s):
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def block(i, a):
    title, url, score, summary = a
    return (
        f'<b>#{i}: <a href="{escape(url)}">{escape(title)}</a></b>\n⭐ <b>Quality Score:</b> {score}/10\n'
        f"📝 <b>Summary:</b>\n{escape(summary)}\n\n" + "─" * 21 + "\n\n"
    )


def size(s):
    return len(s.encode())


def expected(articles, style=STYLE):
    if not articles:
        return [HEADER + style.empty]
    sent, now = [], HEADER
    for i, a in enumerate(articles, 1):
        b = block(i, a)
        if size(now) + size(b) > 3500 and size(now) > size(HEADER):
            sent, now = sent + [now], ""
        now += b
    if size(now) + size(style.footer) > 3900:
        return sent + [now, style.footer]
    return sent + [now + style.footer]


def test_one_article(spark):
    article = ("Engines & Gears", "https://example.com/gears", 9, "1. First.\n2. Second.\n3. Third.")
    (html,) = rendered(spark, lambda d, a, s: render.html_text(render.html_chunks(d, a, s)), [article])
    assert "DAILY DIGEST" in html and "Engines &amp; Gears" in html
    assert "Quality Score:</b> 9/10" in html and 'href="https://example.com/gears"' in html


def test_long_digest_is_split_between_blocks(spark):
    article = ("A Long Story", "https://example.com/test", 7, "One more sentence about the same long story. " * 15)
    (chunks,) = rendered(spark, render.html_chunks, [article] * 15)
    assert len(chunks) > 1
    for chunk in chunks:
        assert size(chunk) <= 4000
        assert chunk.count("<a ") == chunk.count("</a>") and chunk.count("<b>") == chunk.count("</b>")


def test_chunks_follow_the_rule(spark):
    rng = random.Random(11)
    groups = [[], None]
    for _ in range(60):
        groups.append(
            [
                ("T" * rng.randint(0, 90) + "<&", "https://u", rng.randint(1, 10), rng.choice("aé─🚀&") * rng.randint(0, 1500))
                for _ in range(rng.randint(1, 12))
            ]
        )
    # exactly at and one past both limits
    room = 3500 - size(HEADER) - 2 * size(block(1, ("", "", 1, "")))
    groups += [[("", "", 1, "a" * room), ("", "", 1, "")], [("", "", 1, "a" * (room + 1)), ("", "", 1, "")]]
    room = 3900 - size(HEADER) - size(block(1, ("", "", 1, ""))) - size(STYLE.footer)
    groups += [[("", "", 1, "a" * room)], [("", "", 1, "a" * (room + 1))], [("", "", 1, "a" * 9000)]]
    assert rendered(spark, render.html_chunks, *groups) == [expected(g) for g in groups]


def test_wording_is_a_parameter_and_is_not_escaped(spark):
    style = render.Style(title="A & B", footer="x & y")
    (chunks,) = rendered(spark, render.html_chunks, [("t", "u", 1, "s")], style=style)
    assert chunks[0].startswith("🚀 <b>A & B</b>") and chunks[0].endswith("x & y")


def test_markdown(spark):
    out = rendered(spark, render.markdown_text, [("A & <b>", "https://u?a=1&b", 9, "s")], [])
    top = "# 🚀 Daily Digest\n*Wednesday, 09 Sep 2026*\n\n"
    assert out[0] == top + "### 1. [A & <b>](https://u?a=1&b)\n**Quality Score:** 9/10\n\ns\n\n---\n\n"
    assert out[1] == top + "No new high-quality articles processed today.\n"


def test_nothing_is_sent_for_an_empty_digest(spark, tmp_path):
    rows = digests(spark, [], [("t", "u", 1, "s")])
    assert digest.chunks(rows).count() == 2
    digest.write_digest(rows, str(tmp_path / "out"))
    sent = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.digest_date, r.chunk_no) for r in sent] == [(DAY.date(), 0)]
