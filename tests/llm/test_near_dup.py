"""Near-duplicates against brute force, signatures, hot groups, components, defined cases."""

import random
import re

import numpy as np
import pytest

from weftgraph.llm import near_dup, queries
from weftgraph.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < k else frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, percent=80):
    """(doc_id, n, component, kept) by comparing all pairs of texts."""
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, (_, s) in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    shared[j] = shared.get(j, 0) + 1
        for j, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[j][1]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, s) in enumerate(sets):
        if s and d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, s) in enumerate(sets):
        c = least.get(find(i)) if s else d
        out.append((d, len(s), c, d == c))
    return sorted(out, key=repr)


def test_query_against_brute_force(spark, as_set):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, d, "documents").collect()]
    assert as_set(queries.op9_near_dup(spark, d)) == brute(rows, 4)


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed):
    """Groups around the threshold: exact copies, light and heavy edits, chains, shared openings, prefixes."""
    rng = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(90)}" for _ in range(rng.choice((6, 20, 60, 150)))]
        rows += [base] * rng.randrange(1, 4)
        for n in (1, 1, 2, 3, 4, 6):
            rows.append(edited(base, n, rng))
        chain = base
        for _ in range(6):
            chain = edited(chain, 1, rng)
            rows.append(chain)
        rows.append(base[: int(len(base) * 0.82)])
        rows.append(base + base[:3])
    common = [f"c{i}" for i in range(40)]
    rows += [common + [f"t{i}-{j}" for j in range(rng.randrange(2, 30))] for i in range(40)]
    rng.shuffle(rows)
    return [(i * 3 % len(rows) if len(rows) % 3 else i, " ".join(r)) for i, r in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("k", [4, 5])
def test_groups_around_the_threshold(spark, as_set, seed, k):
    rows = corpus(seed)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=k)
    assert as_set(got) == brute(rows, k)


def test_hot_group(spark, as_set):
    """Hundreds of copies of one text, each with an edit of its own, beside exact copies."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(base, rng.randrange(3), rng))) for i in range(400)] + [(1000 + i, " ".join(base)) for i in range(300)]
    assert as_set(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 5)


def test_signature_holds_both_ends():
    rng = np.random.default_rng(1)
    s = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    a, b = near_dup.coefficients(8)
    sig = near_dup.minmax_signature(s, a, b)
    h = s[:, None] * a[None, :] + b[None, :]
    assert (sig == np.concatenate([h.min(axis=0), h.max(axis=0)])).all()


def test_minmax_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    a, b = near_dup.coefficients(600)
    x, y = near_dup.minmax_signature(np.unique(pool[:700]), a, b), near_dup.minmax_signature(np.unique(pool[200:]), a, b)
    assert abs((x == y).mean() - 500 / 900) < 0.06


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(200, 200 + i) for i in range(1, 50)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["comp"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert got == label


def test_shingles_follow_the_contract():
    for text in (None, "", "  ", "One", "A b C", "x\x0by\x0cz\x1cw q r", "É é Ä ä ß a b", "a b c d e a b c d e"):
        for k in (4, 5):
            assert len(near_dup.shingle_set(text, k)) == len(shingles(text, k))
    assert (near_dup.shingle_set("THE cat Sat on it", 4) == near_dup.shingle_set("the\tCAT sat\non IT", 4)).all()
    assert len(near_dup.shingle_set("É b", 4)) and (near_dup.shingle_set("É b", 4) != near_dup.shingle_set("é b", 4)).all()


def test_defined_cases(odd_docs, no_docs, clashing, as_set):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = brute(rows, 5)
    assert as_set(near_dup.near_duplicates(odd_docs)) == want
    assert as_set(near_dup.near_duplicates(clashing(odd_docs).repartition(7))) == want
    assert near_dup.near_duplicates(no_docs).count() == 0
    left = near_dup.deduplicated(clashing(odd_docs))
    assert left.columns == clashing(odd_docs).columns
    gone = {d for d, _, _, kept in want if not kept and d is not None}
    assert sorted(map(repr, (r["doc_id"] for r in left.collect()))) == sorted(repr(d) for d, _ in rows if d not in gone)
    assert near_dup.deduplicated(no_docs).columns == no_docs.columns


def test_rows_without_an_id_of_their_own(spark, as_set):
    """Of rows with a null or a repeated id only the copies go."""
    rng = random.Random(5)
    copied, clean, other = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(40)) for c in "xyz")
    near = copied + " tail"
    rows = [(1, copied), (None, near), (None, clean), (None, None), (7, near), (7, other), (7, ""), (8, copied.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(1, copied), (None, clean), (None, None), (7, other), (7, "")]
    assert as_set(near_dup.deduplicated(docs)) == sorted(kept, key=repr)
    renamed = docs.selectExpr("doc_id AS key", "text AS mark", "'x' AS doc_id")
    assert as_set(near_dup.deduplicated(renamed, id_col="key", text_col="mark")) == sorted(((*r, "x") for r in kept), key=repr)


def exact_links(sets, percent=80):
    """All pairs of different sets at the threshold or above, by the rarest shingles that such a pair must share."""
    sets = sorted(set(sets), key=lambda s: (len(s), sorted(s)[:1]))
    often = {}
    for s in sets:
        for x in s:
            often[x] = often.get(x, 0) + 1
    by, found = {}, []
    for i, s in enumerate(sets):
        first = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for x in first for j in by.get(x, ())}:
            c = len(s & sets[j])
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                found.append((sets[j], s))
        for x in first:
            by.setdefault(x, []).append(i)
    return found


@pytest.mark.parametrize("k", [4, 5])
def test_recall_of_links(spark, k):
    """Every link between different texts joins two rows of one component, and components hold no other rows."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    comp = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, shingle=k).collect()}
    of = {}
    for r in docs.collect():
        if s := shingles(r["text"], k):
            of.setdefault(s, []).append(r["doc_id"])
    links = exact_links(list(of))
    assert links
    assert all(comp[of[a][0]] == comp[of[b][0]] for a, b in links)
    parent = {s: s for s in of}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    least = {}
    for s, ids in of.items():
        least[find(s)] = min(least.get(find(s), ids[0]), *ids)
    assert all(comp[i] == least[find(s)] for s, ids in of.items() for i in ids)
