"""Main text of HTML pages by line-block distribution."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# Element and attribute words of HTML that mark what is not main text.
DROPPED_TAGS = frozenset(
    "head title script style noscript template svg math iframe object canvas nav footer aside form button select textarea dialog menu".split())
RAW_TAGS = "script|style|noscript|template|textarea|svg|iframe"
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement adbox banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs notice notices cookie cookies consent popup modal overlay alert newsletter subscribe subscription share sharing "
    "social related recommended comment comments commentlist reply replies discussion footer header masthead login signup search pagination "
    "pager widget toolbar".split())
ARTICLE_NAMES = frozenset(["header"])  # an article's own head is text
# Words that name a container; the word before tells what it contains.
CONTAINERS = frozenset("area bar block box button buttons container content group holder inner item items link links list outer panel section slot unit wrap wrapper".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())

# HTML: a start tag (key) ends open elements (value) whose end tag may be left out.
_CELL, _ROW = {"td", "th"}, {"td", "th", "tr"}
IMPLIED_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": _CELL, "th": _CELL, "tr": _ROW,
                **dict.fromkeys(("tbody", "thead", "tfoot"), _ROW | {"tbody", "thead", "tfoot"})}
TABLE_TAGS = frozenset("table tbody thead tfoot tr td th caption".split())
HEADINGS_SECTIONS = frozenset("h1 h2 h3 h4 h5 h6 section".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW_TAGS})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WINDOW, SURGE = 3, 60
# A marked article or ``main`` counts if it holds this share of the unlinked text of what it lies in.
MARK_SHARE = 0.5

KEEP, SUSPECT, DROP = 0, 1, 2


def _named(words: list[str], inside: bool, own: bool) -> int:
    """What class and id words say: DROP for a name of boilerplate, SUSPECT where it only qualifies another word.

    Outside of an article any part of a name counts. Within, a compound is what its last word says, containers
    aside: ``site-notice`` and ``share-bar`` go, ``social-history`` is for its text to decide.
    """
    dropped = DROPPED_NAMES - (ARTICLE_NAMES if inside else frozenset())
    verdict = KEEP
    for word in words:
        parts = re.split(r"[-_]+", word)
        if word in dropped or (not inside and not own and not dropped.isdisjoint(parts)):
            return DROP
        if own or dropped.isdisjoint(parts):
            continue
        named = [p for p in parts if p and not p.isdigit()]
        while len(named) > 1 and named[-1] in CONTAINERS:
            named.pop()
        if named[-1] in dropped:
            return DROP
        verdict = SUSPECT
    return verdict


def is_boilerplate(tag: str, attributes: str, in_article: bool, in_main: bool = False) -> int:
    """Whether an element is main text, judged by its name, class, id and role: KEEP, SUSPECT or DROP.

    Headings and sections of an article or ``main`` get their ids from its words, so only whole class names count there.
    """
    if tag in DROPPED_TAGS or (tag == "header" and not in_article):
        return DROP
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return KEEP
    verdict = KEEP
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in DROPPED_ROLES):
            return DROP
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return DROP
        if name in ("class", "id") and tag not in ("article", "main"):
            own = (in_article or in_main) and tag in HEADINGS_SECTIONS
            if own and name == "id":
                continue
            verdict = max(verdict, _named(value.split(), in_article or in_main, own))
            if verdict == DROP:
                return DROP
        if name in ("class", "id") and tag == "article" and any(w.startswith("comment") for w in value.split()):
            return DROP
    return verdict


def close_for_start(opened: list[str], tag: str) -> None:
    """Drop from the open elements those that the start of ``tag`` ends."""
    if tag in BLOCK_TAGS:
        at = next((i for i in range(len(opened) - 1, -1, -1) if opened[i] in BLOCK_TAGS), -1)
        if at >= 0 and opened[at] == "p":
            del opened[at:]
    ended = IMPLIED_ENDS.get(tag)
    if not ended:
        return
    for i in range(len(opened) - 1, -1, -1):
        if opened[i] in ended:
            del opened[i:]
        elif opened[i] == "table" or (tag not in TABLE_TAGS and opened[i] in BLOCK_TAGS and opened[i] not in ("div", "p", "address")):
            return


def close_for_end(opened: list[str], tag: str) -> None:
    """Drop from the open elements the nearest ``tag`` and what is open in it; an end tag reaches no further than its article, table or cell."""
    if tag not in opened:
        return
    for i in range(len(opened) - 1, -1, -1):
        name = opened[i]
        if name == tag:
            del opened[i:]
            return
        if tag in ("article", "main", "body", "html"):
            continue
        if name in ("article", "main", "table") or (name in TABLE_TAGS and tag not in TABLE_TAGS) or (tag not in BLOCK_TAGS and name in BLOCK_TAGS):
            return


class Line(NamedTuple):
    """A block of text; an empty one stands where boilerplate was dropped."""

    text: str
    linked: int = 0
    article: bool = False
    main: bool = False
    suspects: tuple[int, ...] = ()

    @property
    def plain(self) -> int:
        return max(0, len(self.text) - self.linked)


def lines(page: str) -> list[Line]:
    """The text blocks of a page without markup, in order, with one empty line for boilerplate dropped between two.

    Tags without text leave no line, so nested wrappers do not thin out the distribution.
    """
    out: list[Line] = []
    parts: list[str] = []
    open_tags = {"article": 0, "main": 0, "a": 0}
    linked = 0
    opened: list[str] = []
    suspects: list[tuple[int, int]] = []  # (place among the open elements, number) of those that may be boilerplate
    n_suspects = 0
    skip = -1  # the place of the open boilerplate element among the open elements

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Line(text, linked, open_tags["article"] > 0, open_tags["main"] > 0, tuple(n for _, n in suspects)))
        parts.clear()
        linked = 0

    def separate() -> None:
        if out and out[-1].text:
            out.append(Line(""))

    for m in TOKEN.finditer(page):
        token = m.group()
        if token[0] != "<" or token == "<":
            if skip < 0 and (token != "<" or m.end() < len(page)):  # a last "<" starts a tag that never came
                parts.append(token)
                linked += len(token) * (open_tags["a"] > 0)
            continue
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        closing, block = bool(m.group(2)), tag in BLOCK_TAGS
        starts_article = tag in ("article", "main") and not closing and not open_tags[tag] and is_boilerplate(tag, m.group(4), False) != DROP
        skipped = opened[skip] if skip >= 0 else ""
        if skip >= 0 and starts_article:
            del opened[skip:]  # an element left open ends where the article starts
        (close_for_end if closing else close_for_start)(opened, tag)
        if skip >= 0 and len(opened) <= skip:
            itself = closing and tag == skipped and len(opened) == skip
            skip = -1
            if skipped in BLOCK_TAGS:
                flush()
                separate()
            if itself:
                continue
        pushed = not closing and tag not in VOID_TAGS and (block or not (m.group(4) or "").rstrip().endswith("/"))
        if skip >= 0:
            if pushed:
                opened.append(tag)
            continue
        if block:
            flush()
        elif tag == "br":
            parts.append(" ")
        while suspects and suspects[-1][0] >= len(opened):
            suspects.pop()
        if closing:
            if open_tags.get(tag, 0) > 0:
                open_tags[tag] -= 1
        elif pushed:
            verdict = is_boilerplate(tag, m.group(4), open_tags["article"] > 0, open_tags["main"] > 0)
            if verdict == DROP:
                skip = len(opened)
            elif tag in open_tags:
                open_tags[tag] += 1
            if verdict == SUSPECT and block:
                suspects.append((len(opened), n_suspects))
                n_suspects += 1
        if pushed:
            opened.append(tag)
    flush()
    return out


def without_suspects(rows: list[Line], surge: int) -> list[Line]:
    """Drops elements with a doubtful name that are short or mostly links."""
    size: dict[int, list[int]] = {}
    for row in rows:
        for number in row.suspects:
            held = size.setdefault(number, [0, 0])
            held[0] += len(row.text)
            held[1] += row.linked
    gone = {number for number, (n, linked) in size.items() if n < surge or 2 * linked > n}
    return [Line("") if gone.intersection(row.suspects) else row for row in rows] if gone else rows


def marked_part(rows: list[Line]) -> tuple[list[Line], bool]:
    """The lines of the part that the page marks as its article, and whether it marks one.

    ``main`` counts if it holds most of the text of the page, the articles if they hold most of the text
    of that: a teaser marked as an article inside or beside the real text does not replace it.
    """
    def size(part: list[Line]) -> int:
        return sum(row.plain or len(row.text) * (not total) for row in part)

    total = sum(row.plain for row in rows)
    part, marked = rows, False
    for mark in ("main", "article"):
        held = [row for i, row in enumerate(part) if getattr(row, mark) or (not row.text and i and getattr(part[i - 1], mark))]
        if size(held) and size(held) >= MARK_SHARE * size(part):
            part, marked = held, True
    return part, marked


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surge and dive points of the line-block distribution of a page.

    The distribution is the sum of the text lengths of ``window`` lines, links not counted. It surges where the
    sum reaches ``surge`` and dives where it falls to nothing; the text in between stays, with the lines of own text
    that lead up to the surge. Where nothing surges, the run of lines with most text stays. Where the page marks
    its article, the distribution is that of the marked part: the lead may pass what was dropped in it, and it
    stays whole where nothing surges.
    """
    rows, marked = marked_part(without_suspects(lines(page), surge))
    plain = [row.plain for row in rows]
    sums = [sum(plain[i:i + window]) for i in range(len(plain))]
    leads = [bool(n) or (marked and not row.text) for n, row in zip(plain, rows)]
    runs: list[tuple[int, int]] = []  # from a surge, or what leads up to it, to the dive after it
    i = 0
    while i < len(rows):
        if sums[i] >= surge and plain[i]:
            start = i
            while start > (runs[-1][1] if runs else 0) and leads[start - 1]:
                start -= 1
            while i < len(rows) and sums[i]:
                i += 1
            runs.append((start, i))
        i += 1
    if not runs and marked:
        runs = [(0, len(rows))]
    elif not runs:
        edges = [-1, *[i for i, n in enumerate(plain) if not n], len(rows)]
        runs = [max(((a + 1, b) for a, b in zip(edges, edges[1:])), key=lambda r: sum(plain[r[0]:r[1]]))]
    return " ".join(row.text for a, b in runs for row in rows[a:b] if row.text)


def extract_main_text(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; other columns are left aside.

    Whole pages, one narrow pass without shuffle. Null or empty html and pages without main
    text give an empty text; repeated rows give repeated rows; an empty table gives none.
    Null page_id and url pass through. Malformed markup never fails: an unclosed element ends
    with its parent, an unclosed comment or script with the page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, window, surge) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
