"""Operator 11: the main text of web pages by smoothed text-to-tag ratios.

``Page`` takes the events of the standard library's HTML parser as they come and keeps no
tree: a stack of open block elements, and a line for each block of text with its characters,
tags, link characters and innermost container. ``main_text`` then

1. gives each line its text-to-tag ratio (0 for lines in elements that hold no article text:
   menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments; fourfold
   inside ``article`` and ``main``; links do not count as text),
2. smooths the ratios along the page with a Gaussian kernel,
3. clusters the lines by a threshold, ``SHARE`` of the standard deviation of the smoothed
   ratios: runs above it are the content regions,
4. takes the container that holds the regions (from the outermost down, as long as a container
   has no content line or heading of its own and one child holds ``MOST`` of the content), and
   returns all its lines but those of step 1 and those in groups of links, short ones too; where
   no container but the body is left, the lines between the first and the last region.

Elements are told by tag, ARIA role, ``hidden`` marks and words of their class and id
(``NOT_ARTICLE``). Such an element counts as a mere wrapper when an ``article`` or ``main``
stands in it. A heading that only says "Comments" (four languages) ends its container.

Inside a block, white space is one space and ``br`` white space (two in a row part blocks);
table cells are parted by a space, rows and list items are blocks. Pages cut off inside a tag
or comment lose that tag or comment.

Pages are independent: one pass, no shuffle, a page in memory at a time. Defined results:
null and empty html and pages without text give an empty text; repeated rows and ids are
extracted row by row; an empty table gives an empty result; the other columns come back
unchanged in the struct ``page``, so no name can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import small_batches, table

#: Width of the Gaussian kernel in lines; share of the standard deviation; share of the content that a child must hold.
SIGMA, SHARE, MOST = 1.0, 0.5, 0.6
#: Weight of lines inside article or main.
MARKED = 4.0

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead tr ul".split())
#: Elements whose content is never text of a page.
SILENT = frozenset("script style template noscript iframe object svg canvas audio video select textarea button title head".split())
#: Elements that hold no article text.
ASIDE = frozenset("nav aside footer header form dialog menu search label".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Containers that may hold an article (others are part of its text).
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
#: Words of a class or an id that tell what is not the article.
COMMENTS = frozenset("comment comments commentlist disqus replies respond discussion".split())
NOT_ARTICLE = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion "
    "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager header masthead topbar toolbar footer "
    "sidebar sidenav rail widget widgets notice cookie cookies consent gdpr popup modal overlay alert newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations trending search form hidden".split())
#: Words before one of these that say the element only stands with it.
WITH = frozenset("with has no without open closed".split())
COMMENT_HEADING = re.compile(
    r"(\d+\s+)?((reader|user)('?s)?\s+)?(comments?|responses?|replies|kommentare?|commentaires?|comentarios?)(\s*\(?\d+\)?)?:?",
    re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Which open elements a start tag ends, and where the search for them stops.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
        "tbody": ("tbody", "thead"), "tfoot": ("tbody", "thead")}
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",)}


def tells(names: str) -> set[str]:
    """The words of class and id values that NOT_ARTICLE has, unless they follow one of WITH."""
    found = set()
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        found |= {w for i, w in enumerate(words) if w in NOT_ARTICLE and not (i and words[i - 1] in WITH)}
    return found


class Element:
    """A block element: what is needed of it after it has closed."""

    __slots__ = ("tag", "parent", "aside", "comments", "content", "ended")

    def __init__(self, tag: str, parent: Element | None):
        self.tag, self.parent = tag, parent
        self.aside = self.comments = self.content = self.ended = False

    def ancestors(self) -> Iterator[Element]:
        e = self
        while e:
            yield e
            e = e.parent


class Line:
    """A block of text."""

    __slots__ = ("text", "tags", "links", "linked", "element", "out")

    def __init__(self, text: str, tags: int, links: int, linked: int, element: Element, out: bool):
        self.text, self.tags, self.links, self.linked, self.element, self.out = text, tags, links, linked, element, out


class Page(HTMLParser):
    """Parser events to lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", None)
        self.stack, self.lines = [self.root], []
        self.silent = 0          # depth inside silent elements
        self.pieces, self.tags, self.links, self.linked, self.link, self.breaks = [], 0, 0, 0, False, 0

    def flush(self) -> None:
        text = " ".join("".join(self.pieces).split()) if self.pieces else ""
        if text:
            e = self.stack[-1]
            ended = any(x.ended for x in e.ancestors())
            self.lines.append(Line(text, self.tags, self.links, min(self.linked, len(text)), e, ended))
            if e.tag in HEADINGS and COMMENT_HEADING.fullmatch(text):
                self.lines[-1].out = True
                (e.parent or e).ended = True
        self.tags = self.links = self.linked = 0
        self.pieces, self.breaks = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if self.silent:
            self.silent += tag in SILENT
        elif tag in SILENT:
            if tag in ("head", "title") and self.lines:
                return
            self.silent = 1
        elif tag == "br":
            self.breaks += 1
            self.pieces.append(" ")
            if self.breaks > 1:
                self.flush()
        elif tag == "a":
            self.link, self.links = True, self.links + 1
        elif tag in BLOCKS or tag in ASIDE:
            self.open(tag, attrs)

    def open(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            if tag == "html" or any(e.tag == "body" for e in self.stack):
                return
        if tag in ("td", "th") and self.pieces:
            self.pieces.append(" ")
        else:
            self.flush()
        if tag in BLOCKS:
            self.end_implied(tag)
        if tag == "hr":
            return
        e = Element(tag, self.stack[-1])
        given = {k: v or "" for k, v in attrs}
        role = given.get("role", "").lower()
        words = tells(f"{given.get('class', '')} {given.get('id', '')}") if tag != "body" else set()
        hides = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
        e.comments = bool(words & COMMENTS)
        e.aside = bool(tag in ASIDE or role in ROLES or words or hides)
        if (tag in CONTENT or role in CONTENT) and not e.aside:
            e.content = True
            for x in e.ancestors():   # what holds the article is a wrapper, unless it holds comments
                x.aside = x.aside and any(y.comments for y in x.ancestors())
        self.stack.append(e)

    def end_implied(self, tag: str) -> None:
        if self.stack[-1].tag == "p":
            self.stack.pop()
        closes = ENDS.get(tag)
        if closes:
            fence = FENCE.get(tag, ("table",))
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in fence:
                    break
                if self.stack[i].tag in closes:
                    del self.stack[i:]
                    break

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.silent:
            self.silent -= tag in SILENT
        elif tag == "a":
            self.link = False
        elif tag in ("body", "html"):
            self.flush()
        elif tag in BLOCKS or tag in ASIDE:
            if tag not in ("td", "th") or self.stack[-1].tag != tag:   # the text of a plain cell goes on in its row
                self.flush()
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag == tag:
                    del self.stack[i:]
                    break
                if self.stack[i].tag == "table":
                    break

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag == "br" or tag not in SILENT:
            self.handle_starttag(tag, attrs)
            if tag in ASIDE or tag == "a":
                self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.silent:
            return
        self.pieces.append(data)
        if not data.isspace():
            self.breaks = 0
            if self.link:
                self.linked += len(data)


def whole_tags(html: str) -> str:
    """``html`` without a comment or tag that it breaks off in."""
    at = html.rfind("<!--")
    if at >= 0 and html.find("-->", at) < 0 and html.find("</script", at) < 0:
        html = html[:at]
    at = html.rfind("<")
    if at > html.rfind(">") and re.match(r"</?[A-Za-z]|<!", html[at:at + 3]):
        html = html[:at]
    return html


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing (kernel of three sigmas each side, zeros beyond the ends)."""
    r = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(x, kernel / kernel.sum())[r:r + len(x)]


def content_lines(lines: list[Line], sigma: float, share: float) -> np.ndarray:
    """Which lines lie in content regions."""
    ratios = np.array([0.0 if x.out else max(0, len(x.text) - x.linked) / max(1, x.tags)
                       * (MARKED if any(e.content for e in x.element.ancestors()) else 1.0) for x in lines])
    smoothed = smooth(ratios, sigma)
    return (smoothed >= share * smoothed.std()) & np.array([not x.out for x in lines])


def excluded(line: Line) -> bool:
    """In an element without article text; headings of an article's own header stay."""
    own = line.element.tag in HEADINGS
    return any(e.aside and not (own and e.tag == "header" and any(p.content for p in e.ancestors()))
               for e in line.element.ancestors())


def container(lines: list[Line], content: np.ndarray, root: Element) -> Element:
    """The element that holds the content regions."""
    inside, own, children = {}, {}, {}
    for line, chosen in zip(lines, content, strict=True):
        if line.out:
            continue
        weight = len(line.text) - line.linked if chosen else 0
        path = [e for e in line.element.ancestors() if e.tag in CONTAINERS or e is root]
        if chosen or line.element.tag in HEADINGS and line.linked < len(line.text):
            own[path[0]] = True
        for child, parent in zip(path, path[1:], strict=False):
            children.setdefault(parent, {})[child] = None
        for e in path:
            inside[e] = inside.get(e, 0) + weight
    at = root
    while not own.get(at) and not at.content and children.get(at):
        best = max(children[at], key=lambda e: inside[e])
        if inside[best] < MOST * inside[at] or not inside[at]:
            break
        at = best
    return at


def link_groups(lines: list[Line]) -> set[Element]:
    """Lists, tables and containers of at least three lines or links that are mostly links (single lines are marked)."""
    text, linked, count = {}, {}, {}
    for x in lines:
        if x.links >= 3 and x.linked > 0.6 * len(x.text):
            x.out = True
        for e in x.element.ancestors():
            if e.tag in ("ul", "ol", "dl", "table", "div", "section"):
                text[e] = text.get(e, 0) + len(x.text)
                linked[e] = linked.get(e, 0) + x.linked
                count[e] = count.get(e, 0) + 1
    return {e for e in text if count[e] >= 3 and linked[e] > 0.6 * text[e]}


def main_text(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The blocks of the article, joined by newlines."""
    page = Page()
    page.feed(whole_tags(html or ""))
    page.close()
    page.flush()
    lines = page.lines
    groups = link_groups(lines)
    for x in lines:
        x.out = x.out or excluded(x) or any(e in groups for e in x.element.ancestors())
    if all(x.out for x in lines):
        return ""
    content = content_lines(lines, sigma, share)
    at = container(lines, content, page.root)
    keep = [not x.out and any(e is at for e in x.element.ancestors()) for x in lines]
    if at.tag in ("html", "body"):
        found = np.flatnonzero(content)
        first, last = int(found[0]), int(found[-1])
        while first and lines[first - 1].element.tag in HEADINGS and not lines[first - 1].out:
            first -= 1
        keep = [k and first <= i <= last for i, k in enumerate(keep)]
    return "\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame, html: str = "html", sigma: float = SIGMA, share: float = SHARE) -> DataFrame:
    """page (struct of the other columns), text, n_chars."""
    rest = [c for c in pages.columns if c != html]
    packed = pages.select(pages[html].alias("html"), F.struct(*[pages[c] for c in rest]).alias("page"))
    schema = T.StructType([packed.schema["page"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 0):
            texts = [main_text(x, sigma, share) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page", "text", "n_chars"])

    return packed.mapInArrow(run, schema)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page.page_id", "page.url", "text", "n_chars")


#: What the pages of the given tables hold between <article> tags (their only blocks are p and h1), by plain SQL.
_SPACES = "[\\x09-\\x0D\\x1c-\\x20\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
ORACLE_SQL = f"""
WITH blocks AS (
  SELECT page_id, url, string_split_regex(regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''),
    '<br>', ' ', 'g'), '</?(?:p|h1)>') AS bs FROM pages),
plain AS (
  SELECT page_id, url, list_transform(bs, lambda b: regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(b, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;', '''', 'g')) AS bs
  FROM blocks),
texts AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(bs, lambda b:
    trim(regexp_replace(regexp_replace(b, '&amp;?', '&', 'g'), '{_SPACES}', ' ', 'g'))), lambda b: b <> ''), chr(10)) AS text
  FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""
