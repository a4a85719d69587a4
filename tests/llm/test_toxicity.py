"""Toxicity: held-out ranking, calibration, gradients, long texts in chunks, defined cases."""

import zlib

import numpy as np
import pytest

from weftgraph.llm import queries, toxicity
from weftgraph.llm.common import table


@pytest.fixture(scope="module")
def fitted(spark):
    d = "/root/testdata/sf0.1"
    docs = table(spark, d, "documents")
    return docs, toxicity.fit(docs, table(spark, d, "labels")), table(spark, d, "labels")


def test_held_out_rows_are_ranked_and_cut_right(fitted):
    docs, model, labels = fitted
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("toxic IN (0, 1)").collect()
    held = [(r["score"], r["predicted"], r["toxic"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    s, p, y = (np.array(v) for v in zip(*held, strict=True))
    pos, neg = s[y == 1], s[y == 0]
    assert len(pos) >= 5
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.96
    assert (p == y).mean() > 0.94


def test_query(spark, sf_dir):
    rows = queries.op2_toxicity(spark, sf_dir).collect()
    assert len(rows) == table(spark, sf_dir, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_scores_depend_on_the_text_alone(fitted, spark):
    docs, model, _ = fitted
    text = docs.filter("text IS NOT NULL").first()["text"]
    rows = spark.createDataFrame([(i, text, lang) for i, lang in enumerate(("en", "de", None, "xx"))], "doc_id long, text string, lang string")
    assert len({r["score"] for r in toxicity.score(rows, model).collect()}) == 1


def tiny_model(seed=1):
    rng = np.random.default_rng(seed)
    k = len(toxicity.WIDTHS) * toxicity.FILTERS
    w, s = (rng.normal(size=((1 << b) + 1, toxicity.DIM)).astype(np.float32) for b in (toxicity.WORD_BITS, toxicity.STEM_BITS))
    w[-1] = s[-1] = 0
    return toxicity.Model(w, s, rng.normal(size=(2 * toxicity.DIM, sum(toxicity.WIDTHS) * toxicity.FILTERS)).astype(np.float32), rng.normal(size=k).astype(np.float32), rng.normal(size=k).astype(np.float32), 0.1)


def by_position(m, ids):
    """Pooled activations by the definition: every filter at every position of the padded text."""
    e = np.vstack([m.embed(ids), np.zeros((2, 2 * toxicity.DIM))])
    out, k = [], 0
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            cols = [k + o * toxicity.FILTERS + f for o in range(w)]
            out.append(max(sum(e[p + o] @ m.conv[:, c] for o, c in enumerate(cols)) for p in range(len(ids))))
        k += w * toxicity.FILTERS
    return np.maximum(np.array(out) + m.bias, 0)


def test_pooling_is_the_maximum_over_the_whole_text(monkeypatch):
    m, rng = tiny_model(), np.random.default_rng(2)
    cache = toxicity._Ids()
    texts = [toxicity.word_ids(" ".join(f"w{x}" + "abc"[x % 3] for x in rng.integers(0, 50, n)), cache) for n in (1, 2, 3, 40, 17)] + [np.array([-1])]
    want = np.array([by_position(m, t) for t in texts])
    assert np.allclose(m.pooled(texts), want, atol=1e-4)
    for chunk in (1, 2, 5, 16):
        monkeypatch.setattr(toxicity, "_CHUNK", chunk)
        assert np.allclose(m.pooled(texts), want, atol=1e-4)


def test_training_separates_phrases():
    cache, rng = toxicity._Ids(), np.random.default_rng(0)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(200)]
    texts, y = [], []
    for i in range(300):
        own = [words[j] for j in rng.integers(0, 200, 30)]
        if i % 3 == 0:
            own[5:7] = ["vile", "creature"]
        texts.append(toxicity.word_ids(" ".join(own), cache))
        y.append(float(i % 3 == 0))
    m = toxicity.train(texts[:200], np.array(y[:200]))
    logit, z = m.logits(texts[200:]), np.array(y[200:])
    assert logit[z == 1].min() > logit[z == 0].max()


def test_thresholds_by_language():
    score, y = np.array([0.1, 0.2, 0.3, 0.6, 0.7, 0.8] * 4), np.array([0, 0, 0, 1, 1, 1] * 4)
    cut = toxicity._thresholds(score, y, ["en"] * 24)["en"]
    assert 0.3 < cut < 0.6
    assert toxicity._thresholds(score, y, ["en", "de"] * 2 + ["fr"] * 20, least=5).keys() == {"fr"}


def test_defined_cases(fitted, odd_docs, no_docs, clashing, as_set):
    _, model, labels = fitted
    got = toxicity.score(odd_docs, model)
    by_id = {r["doc_id"]: r for r in got.filter("doc_id IS NOT NULL").collect()}
    assert got.count() == odd_docs.count()
    assert by_id[3]["score"] == by_id[4]["score"] == by_id[5]["score"]
    assert as_set(got) == as_set(toxicity.score(clashing(odd_docs), model)) == as_set(toxicity.score(odd_docs.repartition(4), model))
    assert toxicity.score(no_docs, model).count() == 0
    kept = toxicity.keep_clean(clashing(odd_docs), model)
    assert kept.columns == clashing(odd_docs).columns
    assert kept.count() == got.filter("not rejected").count()
    for none in (toxicity.fit(no_docs, labels), toxicity.fit(odd_docs, labels.limit(0))):
        assert {r["score"] for r in toxicity.score(odd_docs, none).collect()} == {0.0}
    nulls = labels.sparkSession.createDataFrame([(None, 1), (1, None), (1, 7), (1, 1)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score(odd_docs, toxicity.fit(odd_docs, nulls)).collect()} <= {0.0, 1.0}


def test_calibration_rows_are_never_trained_on(monkeypatch, spark):
    rng, seen = np.random.default_rng(9), []
    for n, ones in ((300, 60), (12, 2), (7, 1)):
        ids = np.arange(n)
        y = (ids < ones).astype(float)
        held = toxicity._held_out(ids, y)
        assert (held.sum() == 0) == (ones == 1)
        if ones > 1:
            assert set(y[held]) == set(y[~held]) == {0.0, 1.0}
            assert held.sum() == max(1, ones // 5) + max(1, (n - ones) // 5)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 40, 12)) + (" vile" if i % 5 == 0 else ""), "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 5 = 0) AS toxic")
    train, platt = toxicity.train, toxicity._platt
    monkeypatch.setattr(toxicity, "train", lambda texts, y: seen.append(len(texts)) or train(texts, y))
    monkeypatch.setattr(toxicity, "_platt", lambda x, y: seen.append(len(x)) or platt(x, y))
    toxicity.fit(docs, labels)
    usable = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
    assert len(seen) == 2
    assert sum(seen) == usable


def test_the_sample_is_bounded_in_rows_and_words(spark):
    docs = spark.createDataFrame([(i % 20, "word " * 50, "en") for i in range(400)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert len(toxicity._sample(docs, labels, 100, 10**6)) == 100
    assert len(toxicity._sample(docs, labels, 100, 1_000)) == 20
    assert len(toxicity._sample(docs, labels, 7, 10**6)) == 7


def test_few_labels_still_rank(spark):
    """The 305 usable labels of the small table: weak, but above chance by far."""
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter("toxic IN (0, 1)").collect()
    held = [(r["score"], r["toxic"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    s, y = (np.array(v) for v in zip(*held, strict=True))
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.65


def own_word(i):
    return "".join(chr(97 + int(c)) for c in str(10_000 + i))


@pytest.fixture(scope="module")
def many(spark):
    """600 documents that each have a word of their own, every fifth toxic; two ids repeat, two have more labels, some no language."""
    rng = np.random.default_rng(3)
    rows = [(i, f"{own_word(i)} " + " ".join(own_word(9_000 + x) for x in rng.integers(0, 40, 12)) + (" vile" if i % 5 == 0 else ""), ("en", "de", None)[i % 3]) for i in range(600)]
    docs = spark.createDataFrame([*rows, rows[1], rows[2]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*((i, int(i % 5 == 0)) for i in range(600)), (3, 0), (4, 1), (None, 1), (5_000, 1)], "doc_id long, toxic int")
    return docs, labels


@pytest.mark.parametrize("bound", [{"max_labelled": 50}, {"max_words": 200}])
def test_all_labelled_rows_are_learnt_from_beyond_the_drivers_bounds(many, spark, monkeypatch, bound):
    docs, labels = many
    platt, calibrated = toxicity._platt, []
    monkeypatch.setattr(toxicity, "_platt", lambda x, y, n=None: calibrated.append(len(x) if n is None else n.sum()) or platt(x, y, n))
    model = toxicity.fit(docs, labels, **bound)
    cache = toxicity._Ids()
    learnt = [i for i in range(600) if model.words[toxicity.word_ids(own_word(i), cache)[0] >> 32].any()]
    usable = labels.filter("crc32(cast(doc_id AS string)) % 4 <> 2").join(docs, "doc_id")
    ids = {r["doc_id"] for r in usable.collect()}
    assert set(learnt) <= ids
    trained = usable.filter(usable["doc_id"].isin(learnt)).count()
    assert trained + sum(calibrated) == usable.count()
    assert 0.1 * len(ids) < len(ids) - len(learnt) < 0.3 * len(ids)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter("crc32(cast(doc_id AS string)) % 4 = 2").collect()
    assert min(r["score"] for r in rows if r["toxic"]) > max(r["score"] for r in rows if not r["toxic"])


def test_a_fit_on_executors_is_the_same_however_rows_are_dealt(many):
    docs, labels = many
    a, b = (toxicity.fit(d, n, max_labelled=50, shard_rows=100) for d, n in ((docs, labels), (docs.repartition(7), labels.repartition(5))))
    assert np.array_equal(a.flat(), b.flat())
    assert a.scale == b.scale
    assert a.thresholds == b.thresholds
    assert a.thresholds.keys() <= {"en", "de", None}


def test_counts_are_those_of_all_rows(many):
    docs, labels = many
    rows = toxicity._sharded(toxicity._labelled(docs, labels), 5)
    n, pos, cache = np.zeros(sum(toxicity._TABLES)), np.zeros(sum(toxicity._TABLES)), toxicity._Ids()
    for r in docs.join(labels, "doc_id").filter("crc32(cast(doc_id AS string)) % 4 <> 2").collect():
        toxicity._count(n, pos, toxicity.word_ids(r["text"], cache), 1, r["toxic"])
    got = toxicity._counts(rows)
    assert np.array_equal(got[0], n)
    assert np.array_equal(got[1], pos)


def test_calibration_by_counts_is_calibration_by_rows():
    rng = np.random.default_rng(4)
    x, y, n = np.repeat(rng.normal(size=50).round(2), 2), np.tile([0.0, 1.0], 50), rng.integers(0, 5, 100)
    langs = [("en", "de")[i // 2 % 2] for i in range(100)]
    each = np.repeat(np.arange(100), n)
    assert np.allclose(toxicity._platt(x, y, n), toxicity._platt(x[each], y[each]))
    counted, rows = toxicity._thresholds(x, y, langs, n=n), toxicity._thresholds(x[each], y[each], [langs[i] for i in each])
    assert counted.keys() == rows.keys() == {"en", "de"}
    score = lambda cut, lang: [(v >= cut) for v, w, k in zip(x, langs, n, strict=True) if w == lang and k]
    assert all(score(counted[w], w) == score(rows[w], w) for w in rows)


def test_a_class_with_one_id_is_not_calibrated_on_executors(many, spark):
    docs, labels = many
    first = labels.filter("toxic = 1 AND crc32(cast(doc_id AS string)) % 4 <> 2 AND doc_id > 5 AND doc_id < 600").first()["doc_id"]
    model = toxicity.fit(docs, labels.filter(f"toxic = 0 OR doc_id = {first}"), max_labelled=50)
    assert model.scale == (1.0, 0.0)
    assert model.thresholds == {}
    none = toxicity.fit(docs, labels.filter("toxic = 0"), max_labelled=50)
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_no_labelled_document_is_lost_before_the_join(many, monkeypatch):
    docs, labels = many
    want = toxicity._labelled(docs, labels)
    for most in (27, 8):
        monkeypatch.setattr(toxicity, "_MAX_LABEL_BITS", most)
        assert toxicity._labelled(toxicity._likely(docs, labels), labels).exceptAll(want).count() == 0
        assert want.exceptAll(toxicity._labelled(toxicity._likely(docs, labels), labels)).count() == 0
    monkeypatch.undo()
    assert toxicity._likely(docs, labels.filter("doc_id < 20")).count() < 100
