"""Main text of web pages: flat text blocks classified by a decision tree over word counts and link density.

A scanner cuts the whole html into flat blocks at block-level tags. Each block carries its word count and
link density, those of the block before and after it, and what it stands in: an article or main element,
a boilerplate container (menu, header, footer, sidebar, form, and elements whose class, id or role names an advert,
a notice, comments or the like by a whole word; not ``html`` and ``body``), and whether it is a heading. A decision
tree (Gini, grown here) is trained on the table that the scanner measures on the small labelled ``PAGES``; blocks
that it accepts are the main text.

Character references are decoded, white space inside a block becomes one space, ends are trimmed and blocks
join in page order by one line feed; nothing else is dropped and no text is cut. Scripts, styles, templates,
comments and the head hold no text.

Defined cases: a null or empty html, or one without accepted blocks, gives the empty text; unclosed and
stray tags, unclosed comments and scripts are read to the end of the page; pages without an article element
are judged by words and links alone; rows that repeat are extracted alike; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>|<[!?][^>]*>", re.S)
_NAMES = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PARTS = re.compile(r"[a-z]+")
_BOILER_PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner banners promo sponsor sponsored cookie cookies consent notice alert popup modal sidebar menu navbar nav navigation breadcrumb breadcrumbs"
    " footer header masthead comment comments reply replies disqus respond related share sharing social newsletter subscribe widget widgets pagination pager toolbar copyright search complementary contentinfo".split()
)
_MAIN_PARTS = frozenset("article main content post entry story body text".split())
_PLAIN_PARTS = frozenset("no has with without is can hide show".split())  # "has-sidebar" tells of another element
_SKIP = frozenset("script style noscript template svg math iframe object canvas select textarea title".split())
_BOILER = frozenset("nav header footer aside form button dialog menu".split())
_MAIN = frozenset(("article", "main"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_CLOSES_P = _BLOCK - {"br"}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_boiler", "heading")


def _m(n: int, linked: int = 0) -> str:
    """Main text of n words, the last of them linked."""
    return f"+{'w ' * (n - linked)}" + (f"<a href=x>{'w ' * linked}</a>" if linked else "")


def _b(n: int, linked: int = 0) -> str:
    """The same, of boilerplate."""
    return f"-{'w ' * (n - linked)}" + (f"<a href=x>{'w ' * linked}</a>" if linked else "")


def _l(n: int) -> str:
    """A link of n words."""
    return f"<a href=x>-{'w ' * n}</a>"


def _ul(*items: str) -> str:
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"


def _article(k: int) -> str:
    """An article of short and long paragraphs, whole links among them, with little before and after it."""
    sizes = [(5, 1, 60, 2, 14, 1)[(k + i) % 6] + (k * i) % 4 for i in range(6)]
    body = "".join(f"<p>{_m(n, n if (k + i) % 5 == 0 else 0)}</p>" for i, n in enumerate(sizes))
    ends = ("", f"<footer>{_b(1)}</footer>", f"<nav>{_ul(_l(1), _l(2))}</nav>", f"<footer>{_b(12)}</footer>")
    return f"<nav>{_l(1 + k % 3)}</nav><div class=ad>{_b(3 + k)}</div><article><h1>{_m(1 + k % 4)}</h1>{body}</article>{ends[k % 4]}"


#: Small pages whose blocks are labelled in place: main text begins with +, the rest with -. The training table is what
#: the scanner measures on them.
PAGES = (
    *map(_article, range(12)),
    f"<nav>{_ul(_l(1), _l(1), _l(2))}</nav><div class=ad>{_b(9)}</div><article><h1>{_m(8)}</h1><p>{_m(60)}</p><p>{_m(3)}</p><p>{_m(90, 2)}</p><p>{_m(1)}</p><h2>{_m(4)}</h2><p>{_m(25)}</p></article><footer>{_b(14)}</footer>",
    f"<header>{_b(3)}{_ul(_l(1), _l(1))}</header><main><h1>{_m(5)}</h1><p>{_m(2)}</p><p>{_m(12, 12)}</p><p>{_m(150)}</p><ul><li>{_m(6)}</li><li>{_m(4, 1)}</li></ul><p>{_m(40)}</p></main><aside><h3>{_b(2)}</h3><p>{_b(30)}</p></aside><footer>{_b(6)}{_ul(_l(2), _l(1))}</footer>",
    f"<div class=banner>{_b(12)}</div><article><p>{_m(35)}</p><div class=related><h4>{_b(2)}</h4>{_ul(_l(6), _l(5))}</div><p>{_m(70)}</p><div class=ad>{_b(20, 2)}</div><p>{_m(1)}</p><form>{_b(4)}</form></article><div id=comments><h3>{_b(3)}</h3><p>{_b(80)}</p><p>{_b(15)}</p></div>",
    f"<article><h1>{_m(3)}</h1><p>{_m(4)}</p></article><footer>{_b(25)}</footer>",
    f"<article><h1>{_m(9)}</h1><p>{_m(2)}</p><p>{_m(2)}</p><p>{_m(300)}</p><section class=newsletter><p>{_b(22)}</p></section></article><div class=cookie-notice>{_b(30, 2)}</div>",
    # no element tells the article: words and links of a block and its neighbours decide
    f"<div>{_ul(_l(1), _l(2), _l(1))}</div><div><h1>{_m(7)}</h1><p>{_m(80)}</p><p>{_m(45, 2)}</p><p>{_m(20)}</p></div><div>{_l(2)}</div><div>{_l(3)}</div>",
    f"<div>{_l(1)}</div><div>{_l(1)}</div><div>{_b(3)}</div><div>{_l(1)}</div><h2>{_m(5)}</h2><div>{_m(33)}</div><div>{_m(6)}</div><div>{_m(52)}</div><div>{_b(2, 2)}</div><div>{_b(4)}</div><div>{_l(1)}</div>",
    f"<table><tr><td>{_l(2)}</td><td>{_l(2)}</td></tr><tr><td>{_m(110)}</td></tr><tr><td>{_m(28)}</td></tr><tr><td>{_b(5, 4)}</td></tr></table>",
    f"<div>{_b(30, 27)}</div><div>{_b(24, 20)}</div><div>{_m(64)}</div><div>{_m(31, 3)}</div><div>{_b(18, 16)}</div>",
    f"<p>{_m(40)}</p>", f"<p>{_m(16)}</p><p>{_m(90)}</p>", f"<h1>{_m(4)}</h1><p>{_m(22)}</p><p>{_l(1)}</p>", f"<p>{_l(2)}</p><p>{_l(4)}</p><p>{_b(2)}</p>", f"<h3>{_b(3)}</h3>{_ul(_l(3), _l(4), _l(2))}",
    f"<p>{_l(1)}</p><p>{_l(1)}</p><h1>{_m(6)}</h1><p>{_m(25)}</p><h2>{_m(3)}</h2><p>{_m(48)}</p><p>{_l(2)}</p><p>{_b(1)}</p>",
)


def measured(pages: Sequence[str] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """The features of the labelled pages' blocks, and 1 for main text."""
    x, y = [], []
    for page in pages:
        found = blocks(page)
        x += features(found)
        y += [text[0] == "+" for text, *_ in found]
    return np.array(x, float), np.array(y, float)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple | float:
    """(feature, cut, tree for values up to the cut, tree above it), or the share of 1 in a leaf."""
    if depth == 0 or y.min() == y.max():
        return float(y.mean())
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        u = np.unique(x[:, f])
        for cut in (u[1:] + u[:-1]) / 2:
            left = x[:, f] <= cut
            gini = sum(s.sum() * 2 * p * (1 - p) for s in (left, ~left) for p in [y[s].mean()])
            if gini < best[0] - 1e-12:
                best = (gini, f, float(cut))
    if best[0] == np.inf:
        return float(y.mean())
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


@cache
def tree() -> tuple | float:
    return grow(*measured())


def accepts(row: tuple, node: tuple | float) -> bool:
    while not isinstance(node, float):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node >= 0.5


@lru_cache(10_000)
def _named(text: str) -> tuple[int, int]:
    """Whether an attribute's names tell of boilerplate, or of main text: by whole words within each name."""
    boiler = main = 0
    for name in text.strip("\"'").lower().split():
        parts = _PARTS.findall(name)
        if not parts or parts[0] in _PLAIN_PARTS:
            continue
        told = not _MAIN_PARTS.isdisjoint(parts)
        main |= told
        boiler |= not told and not _BOILER_PARTS.isdisjoint(parts)
    return int(boiler), int(main and not boiler)


def marks(name: str, attributes: str | None) -> tuple[int, int]:
    """(boilerplate, main) of an element. Names of the whole page's elements tell nothing of its parts."""
    if name in ("html", "body"):
        return 0, 0
    boiler, main = name in _BOILER, name in _MAIN
    if attributes and "=" in attributes:
        for found in _NAMES.findall(attributes):
            b, m = _named(found) if len(found) < 200 else (0, 0)
            boiler, main = boiler or b, main or m
    return int(boiler), int(main and not boiler)


def blocks(page: str) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, link density, in_main, in_boiler, heading) of each flat block in page order."""
    out: list = []
    stack: list[tuple[str, int, int]] = []  # open elements: name, marks as main, marks as boilerplate
    main = boiler = anchors = heading = 0
    parts: list[str] = []
    linked: list[str] = []
    at, skip = 0, ""

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                words = text.count(" ") + 1
                inside = len(entities.unescape(" ".join(linked)).split()) if linked else 0
                out.append((text, words, min(1.0, inside / words), int(main > 0), int(boiler > 0), int(heading > 0)))
            parts.clear()
            linked.clear()

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if anchors:
                linked.append(text)

    def close(k: int) -> None:
        nonlocal main, boiler, anchors, heading
        while len(stack) > k:
            name, m, b = stack.pop()
            main -= m
            boiler -= b
            anchors -= name == "a"
            heading -= name in _HEADINGS

    for m in _TAG.finditer(page):
        name = m[2]
        if skip:
            if name is None or name.lower() != skip or not m[1]:
                continue
            skip, at = "", m.end()
            continue
        if m.start() < at:
            continue
        add(page[at : m.start()])
        at = m.end()
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCK:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        if name in _SKIP:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        if name in _CLOSES_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if name == "p":  # inline elements that were left open end with their paragraph
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in _BLOCK:
                    break
        is_boiler, is_main = marks(name, m[3])
        stack.append((name, is_main, is_boiler))
        main += is_main
        boiler += is_boiler
        anchors += name == "a"
        heading += name in _HEADINGS
    add(page[at:])
    flush()
    return out


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def features(found: list[tuple]) -> list[tuple]:
    """A row of ``FEATURES`` for each block of a page."""
    none, out = ("", 0, 0.0, 0, 0, 0), []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else none, found[i + 1] if i + 1 < len(found) else none
        out.append((b[1], b[2], before[1], before[2], after[1], after[2], *b[3:]))
    return out


def main_text(page: str | None) -> str:
    found, node = blocks(page or ""), tree()
    return "\n".join(b[0] for b, row in zip(found, features(found), strict=True) if accepts(row, node))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h.as_py()) for h in b.column(2)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(_extract, f"page_id {slim.schema[0].dataType.simpleString()}, url string, text string, n_chars long")
