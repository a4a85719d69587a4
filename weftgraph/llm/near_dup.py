"""Near-duplicate groups by min-max hashing, confirmed on full shingle sets.

Each document becomes the set of its distinct word shingles. Under every hash function both
the smallest and the largest value are kept, so ``functions`` hash evaluations give
``2 * functions`` signature values. Bands of ``rows`` values propose candidates. A link counts
only once the full sets confirm it, so bands decide recall alone: at the default 28 bands of
4 rows a pair at a Jaccard similarity of exactly 0.8 is missed with a probability of 4e-7.

Shingles that no other candidate class holds can't be common
to any pair, so the rest bounds every intersection from above; classes that can't reach the threshold by
that bound leave at once, and it is tested on each pair before any set is fetched. Every member is then
compared with the leader of its bucket, the member with the fewest rare shingles: the likely origin of its
copies. So the members of a group of copies are one component after as many comparisons as the group has classes.
Pairs of different components that are left in a bucket are either named by a shingle that two or three
classes hold, or share none of those, which tightens the bound until hardly any pair but true links
passes. All pairs that pass are compared, so no link that could join two components is lost. Of a bucket in which
many components meet, and which the bound thins out no further, the pairs are met in the join before they are
tested; adaptive execution splits such a key over tasks, as it does with the labels of large components.

Defined cases: null and empty texts have an empty set and no link; a text of fewer words than a
shingle has its whole word sequence as its only shingle; documents of equal sets form one class,
which has one node in the graph; rows with a null id take part and can't be the smallest id; rows
that repeat an id share its component where their texts are equal; an empty table gives an empty
result; columns beyond id and text are ignored whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 28, 4
_CACHE_LIMIT = 100_000
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


class _Hashes(dict):
    """64-bit hash of each word, kept for the words seen of late."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, shingle: int, words: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    cache = _Hashes() if words is None else words
    # bytes.lower() and bytes.split() know A-Z and the six ASCII white-space bytes only
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, tokens), np.uint64, n)
    if n < shingle:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=n)], np.uint64)
    acc = np.zeros(n - shingle + 1, np.uint64)
    for i in range(shingle):
        acc = _finish(acc + h[i : n - shingle + 1 + i] * np.uint64(_MIX[i % len(_MIX)]) + np.uint64(i))
    return np.unique(acc)


def coefficients(functions: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(0, 2**64, functions, dtype=np.uint64) for _ in range(2))
    return a | np.uint64(1), b


def minmax_signature(s: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 4096) -> np.ndarray:
    """Smallest values under all functions, then the largest ones."""
    low, high = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(a), np.uint64)
    for i in range(0, len(s), block):
        h = np.multiply.outer(s[i : i + block], a)
        h += b
        np.minimum(low, h.min(axis=0), out=low)
        np.maximum(high, h.max(axis=0), out=high)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    m, acc = sig.reshape(bands, rows), np.arange(bands, dtype=np.uint64) * np.uint64(_MIX[0])
    for r in range(rows):
        acc = _finish(acc + m[:, r] * np.uint64(_MIX[r % len(_MIX)]))
    return acc.view(np.int64)


def _signer(shingle: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (a, b) = _Hashes(), coefficients(bands * rows // 2)
        for batch in batches:
            cls, sizes, keys = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), shingle, words)
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                keys.append(band_keys(minmax_signature(s, a, b), bands, rows) if len(s) else np.empty(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cls, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *batch.columns[2:]], names=["doc_id", "cls", "n", "bands", *batch.schema.names[2:]])

    return sign


def _mark(text: Column) -> Column:
    """Digest of a text, null for null."""
    return F.unhex(F.md5(text.cast("binary")))


def _setter(shingle: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Hashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                found = [shingle_set(t.as_py(), shingle, words) for t in batch.column(0).slice(i, 512)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                flat = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["cls", "shingles"])

    return sets


def _ordered(pairs: DataFrame, x: str, nx: str, y: str, ny: str) -> DataFrame:
    """(a, b, na, nb) with a < b."""
    first = F.col(x) < F.col(y)
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(first, F.col(nx)).otherwise(F.col(ny)).alias("na"), F.when(first, F.col(ny)).otherwise(F.col(nx)).alias("nb"))


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, comp) of every node of the undirected ``edges`` (a, b); comp is the smallest node reachable.

    Smallest-label propagation with pointer jumping; each round is written to the shared folder.
    """
    both = materialize(edges.select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.select("b", "a")), f"{label}-edges")
    state = materialize(both.groupBy("v").agg(F.min("w").alias("m")).select("v", F.least("v", "m").alias("l")), f"{label}-0")
    step = 0
    while True:
        step += 1
        near = both.join(state.select(F.col("v").alias("w"), "l"), "w").groupBy("v").agg(F.min("l").alias("near"))
        jump = state.select(F.col("v").alias("l"), F.col("l").alias("far"))
        nxt = state.join(near, "v").join(jump, "l").select("v", F.col("l").alias("old"), F.least("l", "near", "far").alias("l"))
        nxt = materialize(nxt, f"{label}-{step}")
        moved = not nxt.filter("l <> old").isEmpty()
        state = nxt.select("v", "l")
        if not moved:
            return state.select(F.col("v").alias("node"), F.col("l").alias("comp"))


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
    id_col: str = "doc_id", text_col: str = "text", marks: bool = False
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; with ``marks`` its text's ``mark`` too.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` on full sets.
    """
    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    marked = slim.withColumn("mark", _mark(slim["text"])) if marks else slim
    signed = materialize(marked.mapInArrow(_signer(shingle, bands, rows), f"doc_id {kind}, cls binary, n long, bands array<long>{', mark binary' if marks else ''}"), "signed")
    # exact copies are one class from here on; partial aggregation collapses hot classes before the shuffle
    classes = signed.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rid"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = materialize(classes, "classes")

    banded = classes.select("cls", "n", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    met = materialize(banded.join(shared, "key"), "met")

    ids = classes.join(met.select("cls").distinct(), "cls", "left_semi").select(F.col("rid").alias("doc_id")).distinct()
    texts = slim.join(ids, slim["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    sets = materialize(texts.mapInArrow(_setter(shingle), "cls binary, shingles array<long>").dropDuplicates(["cls"]), "sets")

    # One row a shingle: how many candidate classes hold it and, for up to three, which (the third from the xor).
    # s: shingles that any other class holds; s3: those that more than three hold.
    held = sets.select(F.xxhash64("cls").alias("h"), F.explode("shingles").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.bit_xor("h").alias("x3")).filter("c <= 3")
    few = F.when(F.col("c") == 1, F.array("lo")).when(F.col("c") == 2, F.array("lo", "hi")).otherwise(F.array("lo", "hi", F.expr("x3 ^ lo ^ hi")))
    held = held.select("c", F.array_sort(few).alias("by"))
    rare = held.groupBy("by", "c").agg(F.count(F.lit(1)).alias("m"))
    rare = materialize(rare, "rare")
    own = rare.select("c", "m", F.explode("by").alias("h")).groupBy("h").agg(F.sum("m").alias("m3"), F.sum(F.expr("if(c = 1, m, 0)")).alias("m1"))
    most = sets.select("cls", F.size("shingles").cast("long").alias("n"), F.xxhash64("cls").alias("h")).join(own, "h", "left")
    most = most.select("cls", "h", (F.col("n") - F.coalesce("m1", F.lit(0))).alias("s"), (F.col("n") - F.coalesce("m3", F.lit(0))).alias("s3"))
    members = materialize(met.join(most, "cls").filter(f"100 * s >= {percent} * n"), "members")

    def reach(na: str, sa: str, nb: str, sb: str) -> str:
        return f"{100 + percent} * least({sa}, {sb}) >= {percent} * ({na} + {nb})"

    # the leader of a bucket is the member of which others hold the largest part: the likely origin of its copies
    heads = members.groupBy("key").agg(F.max(F.struct(F.expr("(s + s3) / n").alias("part"), "cls", "n", "s")).alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    star = members.join(heads, "key").filter("cls <> head.cls").filter(reach("n", "s", "head.n", "head.s"))
    tested = materialize(_ordered(star, "cls", "n", "head.cls", "head.n").distinct(), "pairs")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("cls").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        both = pairs.join(right, "b").join(left, "a").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long"))
        return both.filter(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")

    links = materialize(confirmed(tested), "links")
    comps = components(links)
    # What is left: pairs of different components in one bucket. Either they share no shingle that at most three
    # classes hold, and then s3 bounds what they share, or such a shingle names the pair.
    placed = members.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    rest = materialize(placed.join(split, "key", "left_semi").join(classes.select("cls", "bands"), "cls"), "rest")
    other = rest.select("key", *(F.col(c).alias(f"{c}_x") for c in ("cls", "n", "s3", "comp", "bands")))
    apart = (F.col("comp_x") != F.col("comp")) & (F.col("cls_x") < F.col("cls"))
    once = F.col("key") == F.array_min(F.array_intersect("bands_x", "bands"))  # of the buckets that a pair shares
    near = other.join(rest.drop("h", "s"), "key").filter(apart).filter(reach("n_x", "s3_x", "n", "s3")).filter(once)
    near = _ordered(near, "cls_x", "n_x", "cls", "n")
    each = rest.dropDuplicates(["cls"]).select("h", "cls", "n", "s", "comp")
    two = F.expr("if(c = 2, array(struct(by[0] AS x, by[1] AS y)), array(struct(by[0] AS x, by[1] AS y), struct(by[0] AS x, by[2] AS y), struct(by[1] AS x, by[2] AS y)))")
    named = rare.filter("c > 1").select(F.explode(two).alias("p")).select("p.x", "p.y").distinct()
    named = named.join(each.select(F.col("h").alias("y"), "cls", "n", "s", "comp"), "y").join(each.select(F.col("h").alias("x"), *(F.col(c).alias(f"{c}_x") for c in ("cls", "n", "s", "comp"))), "x")
    named = _ordered(named.filter(F.col("comp_x") != F.col("comp")).filter(reach("n_x", "s_x", "n", "s")), "cls_x", "n_x", "cls", "n")
    fresh = materialize(near.union(named).distinct().join(tested, ["a", "b"], "left_anti"), "fresh")
    more = materialize(confirmed(fresh), "links-more")
    if not more.isEmpty():
        comps = components(links.union(more), "cc-more")

    grouped = classes.select("cls", "rid").join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    smallest = grouped.groupBy("comp").agg(F.min("rid").alias("component_id"))
    final = grouped.join(smallest, "comp").select("cls", "component_id")
    extra = ["mark"] if marks else []
    rows = signed.select("doc_id", "cls", F.col("n").alias("n_shingles"), *extra)
    linked = rows.filter("n_shingles > 0").join(final, "cls").select("doc_id", "n_shingles", "component_id", *extra)
    alone = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *extra)  # no key that all of them would meet at
    return linked.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that aren't the smallest of their component; all columns stay.

    Rows that repeat a kept id with a text of its component all stay, as they are one document. Rows are told apart
    by id and text, so of rows with a null or repeated id only those that ``near_duplicates`` doesn't keep go.
    """
    gone = near_duplicates(docs, marks=True, **options).filter("not kept").select("doc_id", "mark").distinct()
    gone = materialize(gone, "gone")
    own, text = docs[options.get("id_col", "doc_id")], docs[options.get("text_col", "text")]
    # what goes grows with the input: a shuffle at every size, never a broadcast
    return docs.join(gone.hint("merge"), own.eqNullSafe(gone["doc_id"]) & (_mark(text) == gone["mark"]), "left_anti")
