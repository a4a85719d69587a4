"""Exact top-k: the query against its SQL, the dual tree against brute force, ties, defined cases."""

import numpy as np
import pytest

from weftgraph.llm import queries, topk


def brute(ids, x, every, k):
    out = []
    for i, q in zip(ids, x, strict=True):
        if i % every == 0:
            best = sorted((-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), j) for j, v in zip(ids, x, strict=True) if j != i)[:k]
            out += [(int(i), r + 1, int(j), -s) for r, (s, j) in enumerate(best)]
    return sorted(out, key=repr)


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")


def test_query_against_sql(spark, sf_dir, same_rows):
    same_rows(queries.op10_topk(spark, sf_dir), topk.SQL, sf_dir)


@pytest.mark.parametrize("kind", ["gauss", "clusters", "ties", "one"])
@pytest.mark.parametrize("block", [40, 5000])
def test_against_brute_force(spark, as_set, kind, block):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6))
    if kind == "clusters":
        x = rng.normal(size=(5, 6))[rng.integers(0, 5, 300)] + rng.normal(size=(300, 6)) * 0.02
    if kind == "ties":
        x = rng.integers(-1, 2, (300, 6)) / 4
    if kind == "one":
        x = np.tile(x[:1], (300, 1))
    ids = rng.permutation(1000)[:300]
    assert as_set(topk.top_k(frame(spark, ids, x), 5, 10, block)) == brute(ids, np.floor(256 * x), 10, 5)


def test_large_components_stay_exact():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(60, 4)) * 2**27)
    a, b, s = topk.dual_search(np.arange(60), x, np.arange(60), x, 3)
    want = brute(np.arange(60), x, 1, 3)
    assert sorted(zip(a.tolist(), b.tolist(), s.tolist(), strict=True)) == sorted((q, d, v) for q, _, d, v in want)


def test_bounds_leave_pairs_of_nodes_out():
    """On points round few centres most products are never done; on noise of many dimensions none can be left out."""
    rng = np.random.default_rng(4)
    x = np.floor(256 * (rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] * 4 + rng.normal(size=(4000, 8)) * 0.05))
    ids, at = np.arange(4000), np.arange(0, 4000, 20)
    work = {}
    a, b, s = topk.dual_search(ids[at], x[at], ids, x, 5, work=work)
    scores = (x[at] @ x.T).astype(np.int64)
    scores[np.arange(len(at)), at] = -(2**62)
    want = {(int(q), int(d), int(scores[i, d])) for i, q in enumerate(at) for d in np.lexsort((ids, -scores[i]))[:5]}
    assert set(zip(a.tolist(), b.tolist(), s.tolist(), strict=True)) == want
    assert work["products"] < 0.25 * len(at) * len(ids)
    again, floor = {}, np.sort(scores, axis=1)[:, -5]
    topk.dual_search(ids[at], x[at], ids, x, 5, floor=floor, work=again)
    assert again["products"] <= work["products"]
    noise = rng.normal(size=(3000, 64))
    noise = np.floor(256 * noise / np.linalg.norm(noise, axis=1, keepdims=True))
    full = {}
    topk.dual_search(np.arange(60), noise[:60], np.arange(3000), noise, 5, work=full)
    assert full["products"] > 0.99 * 60 * 3000


def test_huge_components(spark):
    rows = [(0, [1e17, 1.0]), (50, [1e300, -1.0]), (1, [1e17, 2.0]), (2, [3.0, 1e306])]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == {(0, 1), (0, 50), (50, 0), (50, 1)}  # 256 * 1e306 is no number any more
    assert set(got.values()) == {2**63 - 1}


def test_seeded_scores_change_nothing(spark, as_set):
    rng = np.random.default_rng(18)
    x = rng.normal(size=(6, 4))[rng.integers(0, 6, 400)] + rng.normal(size=(400, 4)) * 0.05
    ids = rng.permutation(2000)[:400]
    assert as_set(topk.top_k(frame(spark, ids, x), 5, 10, 60, sample=50)) == brute(ids, np.floor(256 * x), 10, 5)


def test_tree_covers_its_points():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(8, 3))[rng.integers(0, 8, 2000)] * 50 + rng.normal(size=(2000, 3))
    root = topk.cover_tree(x, np.arange(2000), leaf=16)
    assert root.kids
    todo = [root]
    while todo:
        n = todo.pop()
        assert np.sqrt(((x[n.at] - n.centre) ** 2).sum(axis=1)).max() <= n.radius
        assert not n.kids or sorted(np.concatenate([k.at for k in n.kids])) == sorted(n.at)
        todo += n.kids


def test_defined_cases(spark, clashing, as_set):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, None), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, [None, 1.0]), (None, [1.0, 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (100, [1.0, 2.0, 3.0]), (150, []), (6, [-0.001, 0.0]), (0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df)
    assert as_set(got) == as_set(topk.top_k(clashing(df)))
    by = {}
    for r in got.orderBy("rank").collect():
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert by[50] == [(5, 32768), (0, 0), (6, -256)]  # of the two vectors of id 0 the smaller one counts
    assert by[0] == [(5, 32768), (6, 0), (50, 0)] or by[0] == [(5, 32768), (50, 0), (6, 0)]
    assert 100 not in by
    assert 150 not in by
    assert all(v != q for q, pairs in by.items() for v, _ in pairs)
    assert topk.top_k(df.limit(0)).count() == 0
