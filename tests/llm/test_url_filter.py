"""URL filters: the query against its SQL, the token index against all patterns, defined cases."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import queries, url_filter

PIECES = ["http://", "https://", "ads", "ad", ".", "/", "?", "&", "=", "#", "utm_source", "casino", "_", "-", "login", "exe", "sessionid", "7f", "banner", "12", "m.", "en", "doubleclick.net", "wp-admin", "cgi-bin", "amp", "tracker", "x", "É"]
MORE = (*url_filter.PATTERNS, r"foo.*bar", r"foo|bar", r"\bads\b", r"(?:x|y)ads/", r"/login$", r"^m\.", r"ads?x", r"(/|#)amp(/|#)", r"[a-z]ads/", r"_casino_", r"x{2}/en/")
url = st.lists(st.sampled_from(PIECES), max_size=12).map("".join)


@given(url)
@settings(max_examples=1500, deadline=None)
def test_index_misses_no_match(text):
    index = url_filter.PatternIndex(MORE)
    want = next((i for i, p in enumerate(MORE) if re.search(p, text, re.ASCII)), None)
    assert index.match(text) == want


def test_rarest_token_files_a_pattern(spark):
    patterns = [r"/ads/", r"/ads/casino/", r"/ads?/casino/poker/", r"[0-9]+"]
    pages = spark.createDataFrame([("http://x/ADS/ads/",), ("http://x/ads/poker/",), ("http://x/casino/casinos/ad",), ("y/ads",), (None,)], "url string")
    seen = url_filter.token_counts(pages, patterns)
    assert seen == {"ads": 3, "poker": 1, "casino": 1, "ad": 1}
    index = url_filter.PatternIndex(patterns, seen)
    assert index.always == [3]
    assert index.by_token == {"ads": {0}, "casino": {1, 2}}
    assert index.candidates("http://x/ads/") == [0, 3]
    assert url_filter.PatternIndex(patterns, {"casino": 9, "poker": 9, "ads": 99}).by_token == {"ads": {0}, "casino": {1, 2}, "ad": {2}}


def test_ordinary_patterns_never_always_run():
    assert url_filter.PatternIndex(url_filter.PATTERNS).always == []


def test_equally_long_rules():
    rules = (("b.org", "/x", "block"), ("org", "/x/a", "allow"), ("b.org", "/x", "allow"))
    assert url_filter.HostRules(rules).match("b.org", "/x/a") == ("b.org/x", "allow")


def test_query_against_sql(spark, sf_dir, same_rows):
    same_rows(queries.op5_url_filter(spark, sf_dir), url_filter.SQL, sf_dir)


CASES = [
    ("http://Example.ORG/en/10?x", "example.org", "/en/10", "example.org/en/1", "block"),
    ("http://a.example.org/es/", "a.example.org", "/es/", "example.org/es/", "block"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://x.org", "x.org", "", None, "allow"),
    ("https://x.com/de/ads/", "x.com", "/de/ads/", "com/de/", "block"),
    ("https://x.com/fr/ads/", "x.com", "/fr/ads/", "com/fr/", "allow"),
    ("https://x.com/en/ads/", "x.com", "/en/ads/", None, "block"),
    ("x.org/ads/", "", "", None, "block"),
    ("HTTP://ÀB.net?q=://z#f", "Àb.net", "", None, "allow"),
    ("http://a\nb.org/p\nq#z", "a\nb.org", "/p\nq", "org/", "allow"),
    ("http:///path", "", "/path", None, "allow"),
    ("http://com/de/x", "com", "/de/x", "com/de/", "block"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_cases(spark, clashing, as_set):
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(None, None)], "page_id long, url string")
    got = url_filter.judged(pages)
    want = sorted([(i, *c[1:]) for i, c in enumerate(CASES)] + [(None, "", "", None, "allow")], key=repr)
    assert as_set(got.drop("pattern")) == want
    clean = clashing(pages)
    assert as_set(url_filter.judged(clean).drop("pattern")) == want
    assert url_filter.judged(pages.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://x.net/" + "a/" * 500_000 + "ads/")] * 2, "page_id long, url string")
    assert [r["verdict"] for r in url_filter.judged(long).collect()] == ["block", "block"]
