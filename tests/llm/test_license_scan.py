"""License scan: the query against its SQL, pruning against all templates, defined cases."""

import random

import pytest

from weftgraph.llm import license_scan as scan
from weftgraph.llm import queries


def test_query_against_sql(spark, sf_dir, same_rows):
    same_rows(queries.op3_license_scan(spark, sf_dir), scan.SQL, sf_dir)


def best_of_all(segment, templates, t):
    own = scan.bigrams(segment)
    if not own:
        return None
    found = [(-2 * len(own & (b := scan.bigrams(body))) / (len(own) + len(b)), name) for name, body in templates.items()]
    dice, name = min(found)
    return (-dice, name) if -dice >= t else None


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_size_bounds_lose_nothing(threshold):
    rng = random.Random(4)
    index = scan.Templates(scan.TEMPLATES, threshold)
    for _ in range(300):
        words = rng.choice(list(scan.TEMPLATES.values())).split()
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(words))
            words[i : i + rng.randrange(3)] = [rng.choice(["x", "license", "the", ""])] * rng.randrange(3)
            words = words or ["x"]
        segment = " ".join(words)
        assert index.best(segment) == best_of_all(segment, scan.TEMPLATES, threshold)


def test_normal_form():
    assert scan.bigrams("The MIT, License.") == {("the", "mit"), ("mit", "license")}
    assert scan.bigrams("v. 2.0. …") == {("v", "2.0")}
    assert scan.bigrams("one") == set()


def test_segments():
    body = scan.TEMPLATES["ISC"]
    half = len(body) // 2
    text = "Intro\n\n" + body[:half] + "\n" + body[half:] + "\n\nReleased under the MIT License.\nReleased under the MIT License.\n"
    name, dice, n = scan.scan_text(text, scan.Templates(scan.TEMPLATES, 0.8))
    assert (name, dice, n) == ("ISC", 1.0, 4)
    assert scan.scan_text(None, scan.Templates(scan.TEMPLATES, 0.8)) == (None, 0.0, 0)


def test_defined_cases(odd_docs, no_docs, clashing, as_set, spark):
    got = scan.scanned(odd_docs)
    assert got.count() == odd_docs.count()
    assert got.filter("license IS NOT NULL").count() == 0
    assert as_set(got) == as_set(scan.scanned(clashing(odd_docs)))
    assert scan.scanned(no_docs).count() == 0
    deep = spark.createDataFrame([(1, "word " * 300_000 + "\nLicensed under CC BY 4.0.")], "doc_id long, text string")
    assert scan.scanned(deep).first()["license"] == "CC-BY-4.0-line"


FILLER = [f"filler{i}" for i in range(1_000)]


def best_window(words, body, t):
    """By all windows."""
    pairs, want = list(zip(words, words[1:], strict=False)), scan.bigrams(body)
    dice = [2 * len(own & want) / (len(own) + len(want)) for i in range(len(pairs)) for j in range(i, len(pairs)) if (own := set(pairs[i : j + 1]))]
    return max((d for d in dice if d >= t), default=0.0)


def test_licence_of_three_paragraphs_before_long_text():
    body = scan.TEMPLATES["MIT"]
    a, b = body.index("The above"), body.index("THE SOFTWARE IS")
    text = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + "\n\n".join([body[:a], body[a:b], body[b:]]) + "\n\n" + " ".join(FILLER)
    name, dice, n = scan.scan_text(text, scan.Templates(scan.TEMPLATES, 0.8))
    assert (name, n) == ("MIT", 1)
    assert dice > 0.99


@pytest.mark.parametrize("name", sorted(scan.TEMPLATES))
def test_licence_between_other_words(name):
    text = " ".join(["This dataset was published in 2020.", *FILLER[:500], scan.TEMPLATES[name], *FILLER[500:]])
    assert scan.scan_text(text, scan.Templates(scan.TEMPLATES, 0.8)) == (name, 1.0, 1)


def test_sentence_after_another():
    text = "This dataset was published in 2020. Licensed under the Apache License, Version 2.0."
    assert scan.scan_text(text, scan.Templates(scan.TEMPLATES, 0.8)) == ("Apache-2.0-line", 1.0, 1)


def test_windows_beside_segments():
    text = "Released under the MIT License.\nSome words first. Licensed under CC BY-NC 4.0. And more words.\nReleased under the MIT License.\n"
    assert scan.scan_text(text, scan.Templates(scan.TEMPLATES, 0.8)) == ("CC-BY-NC-4.0-line", 1.0, 2)


@pytest.mark.parametrize("seed", range(20))
def test_windows_against_all_windows(seed):
    rng = random.Random(seed)
    body = rng.choice(["one two three four five six seven eight nine ten", "a b a c a b d e f a b g", "x y z x y"])
    own = body.split()
    words = [rng.choice(own + ["u", "v"]) for _ in range(15)] + [w for w in own if rng.random() < 0.9] + [rng.choice(own + ["u"]) for _ in range(15)]
    index = scan.Templates({"t": body}, 0.7)
    found = index.windows(words, index.likely(set(zip(words, words[1:], strict=False))))
    assert max((w[0] for w in found), default=0.0) == best_window(words, body, 0.7)


def test_many_repeats_stay_linear():
    index = scan.Templates(scan.TEMPLATES, 0.8)
    assert scan.scan_text("the software is provided " * 30_000, index) == (None, 0.0, 0)
    name, dice, n = scan.scan_text(" ".join([*FILLER, (scan.TEMPLATES["ISC"] + " so ") * 30]), index)
    assert (name, dice, n) == ("ISC", 1.0, 30)
