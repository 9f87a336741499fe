from html.parser import HTMLParser

import duckdb
import pytest

from schedulesmith.llm import extract
from schedulesmith.llm.extract import main_text


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_article_without_boilerplate():
    html = page("<header>Site</header><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- ad --><div class='ad'>Buy <div>now</div></div><article><h1>One &amp; two</h1>"
                "<p>First<br>line.<p>Second <b>bo</b>ld.<aside>side</aside><form>x</form><div class='comments'>me too</div><p>E.</p></article>"
                "<aside>More</aside><footer>&copy; us</footer>")
    assert main_text(html) == "One & two First line. Second bold. E."


def test_unmarked_page_uses_the_distribution():
    text = "A long enough sentence that is clearly the text of this page, and not one of its menus. " * 2
    html = page(f"<div><a href='/'>Home</a></div><div><a href='/x'>Other</a></div><div></div><div></div><div></div><p>{text}</p><p>Short.</p><p>{text}</p>")
    assert main_text(html) == f"{text.strip()} Short. {text.strip()}"


def test_broken_markup():
    assert main_text("") == "" and main_text("<") == "" and main_text("<article>a < b &lt;c&gt; &am") == "a < b <c> &am"
    assert main_text("<nav>menu<article><p>kept</article>") == "kept"
    assert main_text("<article><p class=notice>gone<p>kept</p></article><!-- open") == "kept"
    assert main_text("<article>" + "word " * 100_000 + "</article>") == ("word " * 100_000).strip()
    assert main_text("<main><p>x\n\t y&nbsp;z</p></main>") == "x y z"


def test_boilerplate_by_attribute():
    html = "<article><header class='entry-header'><h1>H</h1></header><p>a</p><p style='display: none'>b</p><div id='ad-slot'>c</div><div class=share-bar>d</div><p>e</p></article>"
    assert main_text(html) == "H a e"
    assert main_text("<main><div class='site_notice'>x<div>y</div></div><p>kept</p></main><div role=contentinfo>z</div>") == "kept"


def test_skips_end_with_their_parent_or_an_implied_end():
    assert main_text("<article><ul><li class=promo>Buy<li>Point two</ul><p>rest</p></article>") == "Point two rest"
    assert main_text("<article><table><tr><td class=ad>Buy<td>Cell<tr class=ad><td>no<tr><td>Row</table><p>rest</article>") == "Cell Row rest"
    assert main_text("<article><dl><dt class=ad>Buy<dd>Text</dl>rest</article>") == "Text rest"
    assert main_text("<article><p>a</p><div class=ad>Buy</article><article><p>b</p></article>") == "a b"
    assert main_text("<article><section><div class=ad><div>Buy</div></section><p>a</p></article>") == "a"
    assert main_text("<article><p>a</p></div></div><p>b</p><p><span class=ad>Buy<p>c</p></article>") == "a b c"


def test_headings_and_sections_of_an_article_keep_their_ids():
    html = "<h2 id=social-impact>H</h2><section id=discussion><p>a</p></section><section class=comments>no</section><section class=discussion-part><p>b</p></section>"
    assert main_text(f"<article>{html}</article>") == main_text(f"<main>{html}</main>") == "H a b"


def test_rows(spark):
    rows = [(1, "u", "<article>é €</article>"), (1, "u", "<article>é €</article>"), (None, None, None), (2, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = sorted(map(tuple, extract.extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "é €", 3), (1, "u", "é €", 3), (None, None, "", 0), (2, "u", "", 0)], key=str)
    assert extract.extract_main_text(pages.limit(0)).count() == 0


LONG = "This is a long text that says what the page is about, word by word, and it goes on."


def test_short_page_and_nested_wrappers():
    assert main_text("<div><p>Short page.</p></div>") == "Short page."
    assert main_text("<div><a href=x>Menu</a></div><p>Short page.</p>") == "Short page."
    assert main_text(f"<div><div><h1>Title here</h1></div></div><div><div><p>{LONG}</p></div></div><div><div><p>End.</p></div></div>") == f"Title here {LONG} End."


def test_marks_count_by_their_share_of_the_text():
    assert main_text(f"<main><h1>T</h1><p>{LONG}</p><article>teaser</article><p>{LONG}</p></main>") == f"T {LONG} teaser {LONG}"
    assert main_text(f"<article>teaser</article><div><p>{LONG}</p><p>{LONG}</p></div>") == f"teaser {LONG} {LONG}"
    assert main_text(f"<main><div>beside</div><article><p>{LONG}</p></article></main>") == LONG
    assert main_text(f"<div>before</div><article><h1>H</h1><aside>x</aside><p>{LONG}</p></article><article>{LONG}</article><div>after</div>") == f"H {LONG} {LONG}"


def test_names_that_only_qualify_a_word():
    assert main_text(f"<article><p>{LONG}</p><div class='social-history'><p>{LONG}</p></div><div id=related-work>{LONG}</div></article>") == f"{LONG} {LONG} {LONG}"
    for gone in (f"<div class='site-notice'>{LONG}</div>", f"<div class='related-links'>{LONG}</div>", f"<div class='notice-board'><a href=x>{LONG}</a></div>",
                 "<div class='notice-board'>short</div>", f"<div class='share_bar_2'>{LONG}</div>"):
        assert main_text(f"<article><p>{LONG}</p>{gone}<p>End.</p></article>") == f"{LONG} End.", gone


def test_runs_of_links_are_dives_in_an_article_too():
    links = "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(5))
    assert main_text(f"<article><h1>H</h1><p>{LONG}</p><ul>{links}</ul><p>Then {LONG}</p></article>") == f"H {LONG} Then {LONG}"


class Plain(HTMLParser):
    """The article of a page of the given tables, by the parser of the standard library: blocks in order, named boilerplate left out."""

    BLOCKS = {"article", "h1", "h2", "h3", "p", "div", "ul", "ol", "li", "section", "table", "tr", "td", "blockquote", "pre"}
    GONE = {"aside", "form", "nav", "footer", "script", "style", "button"}

    def __init__(self):
        super().__init__()
        self.inside, self.gone, self.blocks = 0, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        names = set((dict(attrs).get("class") or "").split())
        if self.gone or tag in self.GONE or names & {"ad", "comments", "notice", "sidebar", "share"}:
            self.gone.append(tag)
        if tag in self.BLOCKS or tag == "br":
            self.blocks.append("") if tag != "br" else self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside -= 1
        if tag in self.gone:
            while self.gone.pop() != tag:
                pass
        if tag in self.BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.gone:
            self.blocks[-1] += data


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_all_given_pages(sf):
    pages = duckdb.sql(f"select html from '/root/testdata/{sf}/pages.parquet'").fetchall()
    for (html,) in pages:
        parser = Plain()
        parser.feed(html or "")
        parser.close()
        want = " ".join(" ".join(b.split()) for b in parser.blocks if b.split())
        assert main_text(html or "") == want
