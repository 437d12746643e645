import datetime
import random

from pyspark.sql import functions as F

from feedloom.functions import text


def test_strip_html(evaluate):
    got = evaluate(text.strip_html, ["<p>a<br>b</p>", " x\n\n y ", "&amp; <script>var a;</script>", "a < b", "<a\nhref>z", ""])
    assert got == ["a b", "x y", "&amp; var a;", "a < b", "z", ""]


def test_white_space_is_the_same_set_everywhere(evaluate):
    points = [c for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    inputs = [f"a{chr(c)}b" for c in points]
    collapsed = [chr(c) for c, out in zip(points, evaluate(text.strip_html, inputs)) if out == "a b"]
    assert collapsed == sorted(text.SPACES)
    trimmed = evaluate(text.trim_space, [f"{c}{c}b{c}" for c in text.SPACES])
    assert set(trimmed) == {"b"}


def test_to_plain_text(evaluate):
    sample = '<b>#1: <a href="https://example.com?a=1&amp;b=2">Title &amp; Test</a></b>\n<i>Summary</i>'
    got = evaluate(text.to_plain_text, [sample, "&amp;lt;", "&lt;b&gt;&quot;", "a<b>c"])
    assert got == ["#1: Title & Test\nSummary", "&lt;", '<b>"', "ac"]


def test_to_plain_text_decodes_in_one_pass(evaluate):
    pairs = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"'}

    def single_pass(s):
        out = ""
        while s:
            hit = next((e for e in pairs if s.startswith(e)), None)
            out, s = (out + pairs[hit], s[len(hit):]) if hit else (out + s[0], s[1:])
        return out

    rng = random.Random(5)
    inputs = ["".join(rng.choice(["&", "amp;", "lt;", "gt;", "quot;", "x"]) for _ in range(12)) for _ in range(300)]
    assert evaluate(text.to_plain_text, inputs) == [single_pass(s) for s in inputs]


def test_escape_html(evaluate):
    assert evaluate(lambda c: text.escape_html(c, quotes=True), ["<b>test & ok</b>", '"']) == [
        "&lt;b&gt;test &amp; ok&lt;/b&gt;",
        "&quot;",
    ]
    assert evaluate(text.escape_html, ['a"<']) == ['a"&lt;']


def cut(s, limit):
    raw = s.encode()
    return s if len(raw) <= limit else raw[:limit].decode(errors="ignore") + "..."


def test_truncate_bytes(evaluate):
    rng = random.Random(7)
    inputs = ["".join(rng.choice("aé─🚀") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    for limit in (4, 7, 12):
        assert evaluate(lambda c: text.truncate_bytes(c, limit), inputs) == [cut(s, limit) for s in inputs]
    edge = ["a" * 12000, "a" * 12001, "a" * 11999 + "é"]
    assert evaluate(lambda c: text.truncate_bytes(c, 12000), edge) == [cut(s, 12000) for s in edge]


def test_split_message(evaluate):
    inputs = ["", "a" * 3800, "a" * 3801, "é" * 3800, "🚀\n" * 4000]

    def pieces(s):
        return [s] if len(s.encode()) <= 3800 else [s[i : i + 3800] for i in range(0, len(s), 3800)]

    assert evaluate(text.split_message, inputs) == [pieces(s) for s in inputs]


def test_format_summary(spark):
    rows = spark.createDataFrame(
        [(0, " three lines ", ["a", "b"]), (1, "s\n", []), (2, "s", None), (3, "", ["x"])], "i int, s string, t array<string>"
    )
    got = [r.y for r in rows.select("i", text.format_summary(F.col("s"), F.col("t")).alias("y")).orderBy("i").collect()]
    assert got == [
        "three lines \n\n💡 Key Takeaways:\n• a\n• b",
        "s",
        "s",
        "💡 Key Takeaways:\n• x",
    ]


def test_dates(evaluate, spark):
    inputs = [
        "Tue, 02 Jan 2024 03:04:05 GMT", "2 Jan 2024 03:04:05 +0100", "Tue, 02 Jan 2024 03:04 EST", "2024-01-02T03:04:05Z",
        "2024-01-02T03:04:05.5+02:00", "2024-01-02", "02 Jan 24 03:04:05 UT", "yesterday", "", None, "Tue, 02 Jan 2024 03:04:05 -05:00",
        "2024-13-45", "Tue, 02 Jan 2024 03:04:05 XYZ",
    ]
    got = evaluate(lambda c: F.date_format(text.parse_feed_date(c), "yyyy-MM-dd HH:mm:ss"), inputs)
    assert got == [
        "2024-01-02 03:04:05", "2024-01-02 02:04:05", "2024-01-02 08:04:00", "2024-01-02 03:04:05",
        "2024-01-02 01:04:05", "2024-01-02 00:00:00", "2024-01-02 03:04:05", None, None, None, "2024-01-02 08:04:05",
        None, None,
    ]
    when = [datetime.datetime(2026, 9, 9, 23, 59)]
    assert evaluate(text.digest_date, when, "timestamp") == ["Wednesday, 09 Sep 2026"]
    assert evaluate(lambda c: F.date_format(text.day_start(c), "yyyy-MM-dd HH:mm"), when, "timestamp") == ["2026-09-09 00:00"]


def test_uuids(evaluate):
    plain = "c73ef32d-f445-4f91-10cd-beff455e5819"
    inputs = [plain, plain.upper(), "{" + plain + "}", "urn:uuid:" + plain, plain.replace("-", ""), "non-existent-id", "", None, "{" + plain]
    assert evaluate(text.canonical_uuid, inputs) == [plain] * 5 + [None] * 4
    assert evaluate(text.is_uuid, inputs) == [True] * 5 + [False] * 4
    made = evaluate(text.uuid_from, ["https://a", "https://a", "https://b"])
    assert made[0] == made[1] != made[2]
    assert evaluate(text.is_uuid, made) == [True] * 3


def test_prompt(spark):
    row = spark.range(1).select(text.build_prompt(F.lit("T"), F.lit("x" * 12001), "Weekly").alias("p")).first()
    assert "readers of Weekly" in row.p
    assert row.p.endswith("Article Title: T\nArticle Content:\n" + "x" * 12000 + "...\n")
