import math
import random
import time

import pytest
from pyspark.sql import functions as F

from feedloom.llm import html_extract
from feedloom.llm.html_extract import main_text, report

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body class="no-sidebar"><header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, many of them, and more. Please accept.</p></div>
<article><header><h1>The &amp; title</h1></header><p>First   paragraph,
with words.<br>And&nbsp;more.</p><p><b>Unclosed here.<p>Short.</p><ul><li>one<li>two</ul>
<aside>An aside.</aside><p>in<span class="ad">buy</span>side</p><div class="share"><a href="x">Share</a></div></article>
<div id="sidebar"><p>Related: some long text, which goes on. And on, and on.</p></div>
<form><p>Your name, please.</p></form><section id="comments"><p>I disagree, strongly, with it all.</p></section>
<footer>&copy; Site</footer></body></html>"""


def test_an_article():
    assert main_text(PAGE) == "The & title\nFirst paragraph, with words. And more.\nUnclosed here.\nShort.\none\ntwo\ninside"


def test_paths_decide_where_no_element_does():
    page = """<div class="top"><a href=x>Home</a> <a href=y>News</a></div><div class="x1"><h1>Head</h1>
    <div class="b"><p>Something happened today, people say. It was big.</p><p>Yes.</p><blockquote>So, there.</blockquote></div></div>
    <table><tr><td><a href=1>one</a></td><td><a href=2>two</a></td></tr></table>"""
    assert main_text(page) == "Head\nSomething happened today, people say. It was big.\nYes.\nSo, there."


def test_the_only_text_may_lie_in_a_form():
    assert main_text("<body><form><div><p>All of it, in a form.</p></div></form></body>") == "All of it, in a form."


def test_character_references():
    assert main_text("<p>a &lt;b&gt; &amp c &#39;d&#x27; &nosuch; &quot</p>") == "a <b> & c 'd' &nosuch; \""


def test_hidden_parts_and_what_only_looks_hidden():
    page = """<body><div class="overflow-hidden"><article><p>Shown, all of it.</p><p class="sr-only">Skip.</p><p hidden>No.</p>
    <div style="display: none">No.</div><label>Mail</label><div class="reader-responses"><p>Well, I say.</p></div></article></div></body>"""
    assert main_text(page) == "Shown, all of it."


def test_odd_pages():
    for page, text in ((None, ""), ("", ""), ("<!-- no end", ""), ("plain text", "plain text"), ("a < b", "a < b"), ("<p>x<br/>y", "x y")):
        assert main_text(page) == text


def test_long_and_hostile_pages_take_linear_time():
    start = time.time()
    for part in ("<div>", "<p>a<li>b", '<a title="', "<!--", "<", "<a ", "</b>", "<p>hello, you.</p>", "&amp"):
        main_text(part * 20_000)
    assert time.time() - start < 20


def test_tables(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, None), (2, "v", "", 0)], "page_id long, url string, html string, text int")
    rows = report(pages).collect()
    assert sorted((r.n_chars, len(r.text)) for r in rows) == sorted([(0, 0), (0, 0)] + [(len(main_text(PAGE)),) * 2] * 2)
    assert report(pages.limit(0)).count() == 0
    assert report(pages.withColumn("html", F.lit("<p>é𝄞</p>"))).first().n_chars == 2


def test_a_lead_beside_the_body_stays():
    lead = "The lead says what it is about, in some words, and who was there. " * 3
    body = "<p>" + "It went on for long, and nobody left. It was late, too. " * 6 + "</p>"
    page = f"<body><div class=post><p>{lead}</p><div class=body>{body * 6}</div></div><div class=sidebar><p>{lead}</p></div></body>"
    for around in ("{}", "<main>{}</main>"):
        assert main_text(around.format(page)).split("\n")[0] == lead.strip()
    assert len(main_text(page).split("\n")) == 7


def test_long_text_outvotes_doubtful_names_inside_an_article():
    long = "We found what others had found, but less of it. This may be due to the season, or the place. " * 3
    page = f"<article><p>{long}</p><section class=discussion><h2>Discussion</h2><p>{long}</p><div class=share>Share</div></section><div class=rating>4 of 5</div></article>"
    assert main_text(page) == f"{long.strip()}\nDiscussion\n{long.strip()}"
    assert main_text(f"<article><p>{long}</p></article><div class=discussion><p>{long}</p></div>") == long.strip()


LONG = "They came early, and it rained. Nobody had thought of that, but some had coats; others had not."


def flat(end):
    """Nothing declares itself: links, a heading, paragraphs and a last line, side by side or in plain elements."""
    body = f"<h1>The day</h1><p>{LONG}</p><p>{LONG} {LONG}</p><p>Yes.</p><p>{LONG}</p><ul><li>Anna<li>Bert</ul><p>{LONG}</p><p>{LONG} Then they went.</p>"
    return f"<div><a href=a>Home</a> <a href=b>News</a></div>{body}{end}"


KEPT = f"The day\n{LONG}\n{LONG} {LONG}\nYes.\n{LONG}\nAnna\nBert\n{LONG}\n{LONG} Then they went."


@pytest.mark.parametrize("around", ["{}", "<body>{}</body>", "<div><div>{}</div></div>", "<table><tr><td>{}</td></tr></table>"])
@pytest.mark.parametrize("end", ["", "<p>Copyright 2020 Company</p>", "<div><a href=a>Imprint</a> <a href=b>Contact</a></div>", "<div>Buy one, now.</div>", "<ul><li><a href=c>More</a><li><a href=d>Old</a></ul>"])
def test_scores_decide_where_nothing_declares_itself(around, end):
    assert main_text(around.format(flat(end))) == KEPT


def test_without_scores_other_blocks_come_out(monkeypatch):
    monkeypatch.setattr(html_extract, "_path_scores", lambda blocks, paths: dict.fromkeys(paths, 1.0))
    assert main_text(PAGE) != "The & title\nFirst paragraph, with words. And more.\nUnclosed here.\nShort.\none\ntwo\ninside"
    assert main_text(flat("<p>Copyright 2020 Company</p><div>Buy one, now.</div>")) != KEPT


def drawn(rng, depth, path, found):
    """A random tree as html; ``found`` gets path, text and linked characters of each block, in page order."""
    out = ""
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "section", "p", "nav"] if depth < 4 else ["p"])
        name = rng.choice(["", "", "x", "y"])
        inner = (*path, f"{tag}.{name}" if name else tag)
        out += f'<{tag} class="{name}">' if name else f"<{tag}>"
        if tag == "p":
            words = " ".join(rng.choice(["alpha", "be,", "gamma.", "d!"]) for _ in range(rng.randint(1, 30)))
            link = rng.choice(["", "", "elsewhere"])
            out += words + (f" <a href=u>{link}</a>" if link else "")
            found.append((inner, f"{words} {link}".strip(), len(link)))
        else:
            out += drawn(rng, depth + 1, inner, found)
        out += f"</{tag}>"
    return out


@pytest.mark.parametrize("seed", range(20))
def test_scores_are_those_of_a_plain_computation(seed):
    found = []
    source = drawn(random.Random(seed), 0, (), found)
    page = html_extract._Page(source)
    paths = [(page.path[e], page.aside[e]) for e, _, _ in page.blocks]
    assert [(t, k) for _, t, k in page.blocks] == [(t, k) for _, t, k in found]
    scores = html_extract._path_scores(page.blocks, paths)

    def ratios(of):
        texts, links = [t for _, t, _ in of], sum(k for _, _, k in of)
        length = sum(map(len, texts)) - links
        marks = sum(t.count(c) for t in texts for c in ",.!")
        return math.log(1 + length / len(of)) * (1 + math.log(1 + marks / len(of))) * length / max(1, length + links)

    want = [0.0 if any(t.startswith("nav") for t in p) else ratios([f for f in found if f[0] == p]) for p, _, _ in found]
    assert [scores[p] for p in paths] == pytest.approx(want)
    live = [i for i, w in enumerate(want) if w > 0]
    own = [math.sqrt(want[i] * ratios([found[i]])) for i in live]
    smooth = {i: sum(own[j] * (0.4, 0.2, 0.1)[abs(j - k)] for j in range(len(own)) if abs(j - k) < 3) for k, i in enumerate(live)}
    got = html_extract._block_scores(page.blocks, paths, scores, [False] * len(found))
    assert got == pytest.approx([smooth.get(i, 0.0) for i in range(len(found))])
