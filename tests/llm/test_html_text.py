"""HTML extraction: blocks, features, the tree, references, defined cases."""

from html.parser import HTMLParser

import pytest

from weftgraph.llm import html_text, queries
from weftgraph.llm.common import table

PROSE = "A fairly long paragraph of running prose that goes on for well over twenty words so that nobody could take it for a menu entry or a button label."
PAGE = f"""<!DOCTYPE html><html><head><title>No &amp; title</title><style>p {{ x }}</style><script>if (a < b) document.write("<p>no</p>");</script></head>
<body class="page"><header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it work.</div>
<main><article><h1>Head &lt;line&gt;</h1><p>{PROSE}</p><p>Short<br>pair &#233;&nbsp;&eacute;</p>
<aside class="ad">Buy now, {PROSE}</aside><!-- <p>comment</p> --><p>See <a href="x">this link</a> and <b>bold</b>
   words.</p><form><label>Name</label><button>Send</button></form></article>
<section id="comments"><h2>Comments</h2><p>{PROSE}</p></section></main>
<div class="sidebar"><p>{PROSE}</p></div><footer>(c) 2020 {PROSE}</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == f"Head <line>\n{PROSE}\nShort\npair é é\nSee this link and bold words."


def test_pages_without_an_article_go_by_words_and_links():
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>About</a></div><h1>Title of the page here</h1><div>{PROSE}</div><div>{PROSE}</div><div><a href=1>Back</a></div></body>"
    assert html_text.main_text(page) == f"Title of the page here\n{PROSE}\n{PROSE}"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<nav>x</nav>", ""), ("<article>open <p>end", "open\nend"), ("<article><p>a<p>b</article>", "a\nb"), ("<article>x<!-- never closed", "x"), ("<article>x<script>y", "x"),
        ("<article>1 < 2 & 3 > 2</article>", "1 < 2 & 3 > 2"), ("<article></p></div>stray</article>", "stray"), ("<ARTICLE>Upper</ARTICLE>", "Upper"), ("<article>a<span>b</span>c</article>", "abc"), ('<article title="a > b">x</article>', "x"),
        ("<article>&amp;lt; &#x41;&#66;</article>", "&lt; AB"), ("<article>a\n\t  b</article>", "a b"), ("<article><table><tr><td>1</td><td>2</td></tr></table></article>", "1\n2"), ("<article><pre>a\n b</pre></article>", "a b"),
    ],
)
def test_small_pages(page, want):
    assert html_text.main_text(page) == want


def features_used(node):
    return set() if isinstance(node, float) else {html_text.FEATURES[node[0]]} | features_used(node[2]) | features_used(node[3])


def test_tree_fits_the_measured_table():
    x, y = html_text.measured()
    assert all(html_text.accepts(tuple(r), html_text.tree()) == bool(label) for r, label in zip(x, y, strict=True))
    used = features_used(html_text.tree())
    assert {"words", "links"} <= used
    assert used & {"words_before", "links_before", "words_after", "links_after"}


@pytest.mark.parametrize("top", ['<body class="no-sidebar">', '<body class="single-post has-sidebar">', '<html class="no-search"><body>', '<body id="comments-page">'])
def test_names_on_the_whole_page_tell_nothing(top):
    page = f'{top}<nav><a>x</a></nav><article><h1>T</h1><p data-id="comment-3">{PROSE}</p><div class="side-note">Note.</div><div class="article-header">Head.</div><p class=comment>gone</p></article>'
    assert html_text.main_text(page) == f"T\n{PROSE}\nNote.\nHead."


@pytest.mark.parametrize(
    ("name", "attributes", "want"),
    [
        ("div", ' class="ad"', (1, 0)), ("div", ' class="adapter"', (0, 0)), ("div", ' id="cookie-notice"', (1, 0)), ("div", ' data-class="ad"', (0, 0)), ("div", ' class="post-content"', (0, 1)), ("div", ' class="main ad"', (1, 0)), ("div", ' role=navigation', (1, 0)),
        ("div", ' class="has-sidebar"', (0, 0)), ("aside", None, (1, 0)), ("article", None, (0, 1)), ("body", ' class="sidebar"', (0, 0)), ("div", ' class="post-footer"', (0, 1)), ("div", ' CLASS=Site-Footer', (1, 0)),
    ],
)
def test_marks(name, attributes, want):
    assert html_text.marks(name, attributes) == want


def by_parser(page):
    """Text of the article element, cut at block tags, by the parser of the standard library."""

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.found = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag in html_text._BLOCK:
                self.found.append("")

        def handle_endtag(self, tag):
            if tag in html_text._BLOCK:
                self.found.append("")
            self.inside -= tag == "article"

        def handle_data(self, data):
            self.found[-1] += data if self.inside else ""

    reader = Reader()
    reader.feed(page or "")
    reader.close()
    return "\n".join(t for part in reader.found if (t := " ".join(part.split())))


def test_features():
    got = html_text.blocks('<article><h2>A title</h2><p>one <a href="#">two three</a> four</p></article><nav><a>x</a></nav>')
    assert got == [("A title", 2, 0.0, 1, 0, 1), ("one two three four", 4, 0.5, 1, 0, 0), ("x", 1, 1.0, 0, 1, 0)]


def test_depth_and_length():
    assert html_text.main_text("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>") == "deep"
    words = "word " * 200_000
    assert html_text.main_text(f"<article><p>{words}</p></article>") == words.strip()
    assert html_text.main_text("<" * 50_000) is not None
    assert html_text.main_text('<a href="' * 5_000) is not None


def test_query(spark, sf_dir):
    rows = queries.op8_html_text(spark, sf_dir).collect()
    assert len(rows) == table(spark, sf_dir, "pages").count()
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    for r in rows:
        assert r["text"] == by_parser(pages[r["page_id"]])


def test_defined_cases(spark, clashing, as_set):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>")], "page_id long, url string, html string")
    got = html_text.extracted(pages)
    assert got.count() == 5
    assert as_set(got) == as_set(html_text.extracted(clashing(pages)))
    assert html_text.extracted(pages.limit(0)).count() == 0
