"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks, each with the path of block elements from the root.
Text length and punctuation are summed per path and divided by the path's blocks; with the share of
text outside links and what the path declares itself to be (navigation, a form, an advert and the like
weigh nothing) they are fused into the path's score. A block's score is its path's, fused with
the block's own ratios; a heading takes that of what it heads. Scores are smoothed along the page and compared
with a threshold, as those of the paths are, so that a short line between paragraphs stays and one after them does not. The element
that holds nearly all text of the chosen blocks is the article. If it declares itself (article, main), all its blocks with
a score are the text; else the chosen ones, and what stands between them in that element and is no list of links. Inside an article,
a section whose class is a word of ordinary titles too (discussion, survey) is set aside only
if it holds no long, punctuated block.

Null and empty html give an empty text. Every page is read whole, in one pass; pages are
independent, so repeated rows get equal results, and other columns are left alone.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shares of the best block's smoothed score and of the best path's that a block needs.
THRESHOLD, PATH = 0.55, 0.6
#: Weights of a block and its neighbours on either side.
SMOOTH = (0.4, 0.2, 0.1)
#: Share of the chosen text that an element must hold for the article to lie inside it.
HOLDS = 0.85

_PUNCTUATION = re.compile(r"[.,;:!?。、，]")
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?|[\"'])*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

# Elements of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
NOT_TEXT = frozenset("head script style textarea title iframe noembed noframes noscript template svg canvas object audio video select button datalist map label legend".split())
ASIDE = frozenset("nav footer aside form dialog menu fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status toolbar".split())
#: An opening tag ends these open ones, up to the nearest of the stops.
ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
    "th": ("td th", "tr table"), "tbody": ("tr td th thead tbody", "table"), "thead": ("tr td th", "table"), "tfoot": ("tr td th tbody", "table"),
}
_ENDS = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in ENDS.items()}
#: Words in class or id of what is not the article.
_ASIDE_WORD = re.compile(
    r"(?:comment|comments|commentlist|commenter|disqus|discussion|replies|reply|respond|response|responses|nav|navi|navbar|navigation|menu|menubar|submenu|sidebar|sidebars|breadcrumb|breadcrumbs|"
    r"footer|footnav|ad|ads|adv|adbox|adslot|adsense|adsbygoogle|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promos|promotion|promoted|"
    r"cookie|cookies|consent|gdpr|notice|notices|alert|alerts|notification|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|signin|"
    r"share|sharing|sharebar|social|related|recommended|recommendations|recommendation|teaser|teasers|pagination|pager|toolbar|widget|widgets|masthead|banner|"
    r"copyright|colophon|search|searchbox|form|outbrain|taboola|announcement|trending|rail|disclaimer|feedback|rating|poll|survey|paywall)\Z"
)
#: Those of them that an article's own section may have as a name.
_DOUBTFUL = frozenset("discussion response survey poll rating search form rail notice".split())
#: Characters outside links and punctuation marks of a block that speaks for such a section.
LONG, MARKS = 200, 3
_HEADER_WORD = re.compile(r"(?:header|topbar|topnav|masthead)\Z")
#: Whole class names of what is not shown.
_HIDDEN = frozenset("hidden d-none is-hidden visually-hidden sr-only screen-reader-text".split())
_NEGATED = frozenset("no has with without not".split())
_NEVER = frozenset("html body main".split())


def _set_aside(tag: str, attributes: str, in_article: bool) -> bool | None:
    """Whether the element says that it is something else than the article; None if that is doubtful."""
    if tag in ASIDE or (tag == "header" and not in_article):
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    if tag in _NEVER:
        return False
    values = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
    if values.get("role", "").lower() in ROLES or values.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", _ATTRIBUTE.sub("", attributes)) or re.search(r"display\s*:\s*none", values.get("style", "")):
        return True
    doubtful = False
    for name in (*values.get("class", "").split(), values.get("id", "")):
        if name.lower() in _HIDDEN:
            return True
        before = ""
        for word in (w.lower() for w in _WORDS.findall(name)):
            if before not in _NEGATED and (_ASIDE_WORD.match(word) or not in_article and _HEADER_WORD.match(word)):
                if not in_article or word not in _DOUBTFUL:
                    return True
                doubtful = True
            before = word
    return None if doubtful else False


class _Page:
    """Elements and text blocks of a page, in page order."""

    def __init__(self, source: str):
        # of each element: parent, tag, path, whether set aside, the outermost doubtful element around it
        self.parent, self.tag, self.path, self.aside, self.doubt = [0], [""], [0], [False], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self._paths: dict[tuple[int, str], int] = {}
        self._stack, self._open = [0], {}
        self._articles = 0
        self._silent = 0  # open elements whose text is none
        self._muted: set[int] = set()
        self._links = 0
        self._text: list[str] = []
        self._linked = 0
        self._read(source)
        self._settle()

    def _settle(self) -> None:
        """Sets doubtful elements aside that hold no long, punctuated block."""
        own = {
            self.doubt[element]
            for element, text, linked in self.blocks
            if not self.aside[element] and len(text) - linked >= LONG and len(_PUNCTUATION.findall(text)) >= MARKS
        }
        self.aside = [aside or doubt > 0 and doubt not in own for aside, doubt in zip(self.aside, self.doubt)]

    def _flush(self) -> None:
        if self._text:
            text = " ".join(html.unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _push(self, tag: str, attributes: str) -> None:
        up = self._stack[-1]
        label = tag
        if "class" in attributes:
            m = re.search(r"class\s*=\s*[\"']?([^\"'>]*)", attributes)
            label = f"{tag}.{re.sub(r'[0-9]+', '', m[1]).strip()}" if m else tag
        path = self._paths.setdefault((self.path[up], label), len(self._paths) + 1)
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(path)
        aside = _set_aside(tag, attributes, self._articles > 0)
        self.aside.append(self.aside[up] or aside is True)
        self.doubt.append(self.doubt[up] or (len(self.tag) - 1 if aside is None else 0))
        self._stack.append(len(self.tag) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1
        self._articles += tag in ("article", "main")
        self._silent += tag in NOT_TEXT

    def _pop(self) -> str:
        element = self._stack.pop()
        tag = self.tag[element]
        self._open[tag] -= 1
        self._silent -= element in self._muted
        self._articles -= tag in ("article", "main")
        self._silent -= tag in NOT_TEXT
        return tag

    def _begin(self, tag: str, attributes: str) -> None:
        if self._open.get("head") and tag == "body":
            self._end("head")
        if tag in BLOCK and self._open.get("p") and tag not in ("html", "body"):
            self._close(frozenset(["p"]), frozenset("td th table article section div aside main body li blockquote".split()))
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        if tag in ("html", "body") and self._open.get(tag):
            return
        self._push(tag, attributes)

    def _close(self, tags: frozenset[str], stops: frozenset[str]) -> None:
        """Close the nearest open one of these tags, and what is open inside, unless a stop is nearer."""
        if not any(self._open.get(t) for t in tags):
            return
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[k]]
            if tag in stops:
                return
            if tag in tags:
                while len(self._stack) > k:
                    self._pop()
                if k > 1 and self.tag[self._stack[-1]] in tags:
                    self._close(tags, stops)
                return

    def _end(self, tag: str) -> None:
        if self._open.get(tag):
            while self._pop() != tag:
                pass

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = _MARKUP.search(source, at)
            stop = m.start() if m else n
            if stop > at and not self._silent:
                part = source[at:stop]
                self._text.append(part)
                if self._links:
                    self._linked += len(part.strip())
            if m is None:
                break
            at = m.end()
            close, begin = m[1], m[2]
            if close:
                self._closing(close.lower())
            elif begin:
                tag = begin.lower()
                at = self._opening(tag, m[3], source, at)
        self._flush()

    def _closing(self, tag: str) -> None:
        if tag == "a":
            self._links = max(0, self._links - 1)
        elif tag in BLOCK or tag in NOT_TEXT or "-" in tag or self._open.get(tag):
            self._flush_block(tag)
            self._end(tag)

    def _flush_block(self, tag: str) -> None:
        if tag in BLOCK or "-" in tag:
            self._flush()

    def _opening(self, tag: str, attributes: str, source: str, at: int) -> int:
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I).search(source, at)
            return end.end() if end else len(source)
        if tag == "br":
            self._text.append(" ")
        elif tag in VOID:
            if tag == "hr":
                self._flush()
        elif attributes.endswith("/") and tag not in BLOCK:
            pass
        elif tag == "a":
            self._links += 1
        elif tag in BLOCK or tag in NOT_TEXT or "-" in tag:
            self._flush_block(tag)
            if tag in BLOCK:
                self._links = 0
            self._begin(tag, attributes)
        elif attributes and _set_aside(tag, attributes, self._articles > 0) is not False:
            # an inline element, such as an advert in a span: its text is left out of the block
            self._push(tag, attributes)
            self._muted.add(len(self.tag) - 1)
            self._silent += 1
        return at


#: What a block is filed under: its path, and whether that is set aside.
_Path = tuple[int, bool]


def _fused(blocks: int, length: int, marks: int, linked: int) -> float:
    """Text and punctuation a block, and the share of text outside links, as one figure."""
    return math.log1p(length / blocks) * (1 + math.log1p(marks / blocks)) * length / max(length + linked, 1)


def _path_scores(blocks: list[tuple[int, str, int]], paths: list[_Path]) -> dict[_Path, float]:
    """The fused ratios of each path; 0 for one that is set aside."""
    sums: dict[_Path, list[int]] = {}
    for (_, text, linked), path in zip(blocks, paths):
        s = sums.setdefault(path, [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(text) - linked
        s[2] += len(_PUNCTUATION.findall(text))
        s[3] += linked
    return {path: 0.0 if path[1] else _fused(*s) for path, s in sums.items()}


def _block_scores(blocks: list[tuple[int, str, int]], paths: list[_Path], scores: dict[_Path, float], headings: list[bool]) -> list[float]:
    """The blocks' scores, smoothed along the page. Beyond its ends there is nothing; blocks without a score are passed over."""
    places = [i for i, path in enumerate(paths) if scores[path] > 0]
    own: list[float] = []
    for i in places:
        _, text, linked = blocks[i]
        own.append(math.sqrt(scores[paths[i]] * _fused(1, len(text) - linked, len(_PUNCTUATION.findall(text)), linked)))
    for k in range(len(own) - 2, -1, -1):
        if headings[places[k]]:
            own[k] = max(own[k], own[k + 1])
    found = [0.0] * len(blocks)
    for k, i in enumerate(places):
        near = SMOOTH[0] * own[k]
        for away in range(1, len(SMOOTH)):
            near += SMOOTH[away] * ((own[k - away] if k >= away else 0.0) + (own[k + away] if k + away < len(own) else 0.0))
        found[i] = near
    return found


def _article(page: _Page, mass: list[int]) -> tuple[int, int]:
    """The innermost element that holds nearly all of the mass, and the innermost article or main around it (0: none)."""
    for element in range(len(mass) - 1, 0, -1):
        mass[page.parent[element]] += mass[element]
    article, declared = 0, 0
    for element in range(1, len(mass)):
        # elements come after their parents, so this walks down as long as one child holds nearly all
        if page.parent[element] == article and page.tag[article] != "article" and page.tag[element] not in _LEAF and mass[element] >= HOLDS * mass[0]:
            article = element
            if page.tag[element] in ("article", "main"):
                declared = element
    return article, declared


def _within(page: _Page, top: int) -> list[bool]:
    """Whether each element is ``top`` or inside it."""
    inside = [False] * len(page.tag)
    for element in range(len(inside)):
        inside[element] = element == top or element > 0 and inside[page.parent[element]]
    return inside


def main_text(source: str | None) -> str:
    """The article's blocks, one to a line."""
    if not source:
        return ""
    page = _Page(source)
    blocks = page.blocks
    aside = [page.aside[element] for element, _, _ in blocks]
    if all(aside) and ("article" in page.tag or "p" in page.tag):
        # everything lies in elements set aside, such as one form around the page
        aside = [any(t in ("nav", "footer") for t in _tags_above(page, element)) for element, _, _ in blocks]
    paths = [(page.path[element], a) for (element, _, _), a in zip(blocks, aside)]
    scores = _path_scores(blocks, paths)
    headings = [page.tag[element] in _HEADING for element, _, _ in blocks]
    near = _block_scores(blocks, paths, scores, headings)
    best = max(near, default=0.0)
    if best <= 0:
        # links alone, or nothing
        return "\n".join(text for (_, text, _), a in zip(blocks, aside) if not a)
    least = PATH * max(scores[path] for path, score in zip(paths, near) if score > 0)
    chosen = [score >= THRESHOLD * best and (scores[path] >= least or heading) for score, path, heading in zip(near, paths, headings)]
    if not any(chosen):
        chosen = [score >= THRESHOLD * best for score in near]
    mass = [0] * len(page.tag)
    for (element, text, linked), take in zip(blocks, chosen):
        if take:
            mass[element] += len(text) - linked + 1
    article, declared = _article(page, mass)
    inside, around = _within(page, article), _within(page, declared)
    sure = article > 0 and article == declared
    first, last = chosen.index(True), len(chosen) - 1 - chosen[::-1].index(True)
    lines = []
    for i, (element, text, linked) in enumerate(blocks):
        menu = 2 * linked > len(text)
        if sure:
            take = inside[element]
        else:
            take = not menu and (chosen[i] and around[element] or inside[element] and first < i < last)
        title = page.tag[element] == "h1" and element < article
        if (take or title) and not (aside[i] and scores[paths[i]] <= 0):
            lines.append(text)
    return "\n".join(lines)


_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold one block; the article is around them.
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody tr td th figure figcaption".split())


def _tags_above(page: _Page, element: int) -> Iterator[str]:
    while element:
        yield page.tag[element]
        element = page.parent[element]


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = pa.array([main_text(h) for h in part["html"].to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], texts], ["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
