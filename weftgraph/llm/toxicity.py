"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the concatenation of two hashed rows: one for the whole word and one for its
first four letters, so that inflected forms share evidence. Filters of several widths slide over the
words, their largest activation in the whole text feeds a logistic unit. The first dimension of both
parts starts at the shrunk log-odds of the row in the training texts; rows that no training text
holds stay at zero. A fifth of the labelled ids of each class isn't trained on: on their rows scores are
Platt-calibrated, and so is a threshold for each language that has ``LEAST`` of them of both classes there; other
languages keep ``THRESHOLD``. Language picks a threshold only; it is never an input of a score.

The fit takes every labelled row. Up to ``MAX_LABELLED`` rows of ``MAX_WORDS`` words together the driver trains on all
of their word ids. Beyond either, executors do: word counts are summed over all rows; in each of ``ROUNDS`` rounds every
shard of about ``SHARD_ROWS`` rows trains on from the same model, row by row, and the shards' moves are averaged (an
embedding's over the shards that moved it); calibration and thresholds come from the counts of all held rows by logit,
which is a multiple of ``1 / LOGIT_STEPS``. Sums are of integers, so they don't depend on which task adds first. The
driver then holds a model, its sums, counts by logit, and a bit table of label ids of 16 MB at most, and a threshold for
each language. Scores are computed for every whole text, whatever its length.

Defined cases: null and empty texts are one padding word and get that text's score; labels whose id
or label is null, or that have no document, don't train; rows that repeat an id each count as a labelled row (on
executors a document is one row that weighs as many as its id has labels);
without labels of both classes every score is the share of label 1 (0 without labels); a class with one labelled id
trains with it, and then nothing is calibrated; rows that repeat are scored alike; extra columns pass
through ``keep_clean`` unchanged. Equal texts have equal scores whatever they are batched with.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

MAX_LABELLED, MAX_WORDS, THRESHOLD, LEAST = 5_000, 8_000_000, 0.3, 10
SHARD_ROWS, ROUNDS, BATCH, RATE, SEED = 1_000, 4, 32, 0.01, 5
LOGIT_STEPS, _MOVE_STEPS, _BUCKET_BITS, _MAX_LABEL_BITS = 1 << 10, 1 << 20, 16, 27
WORD_BITS, STEM_BITS, STEM = 18, 17, 4
WIDTHS, FILTERS, DIM = (1, 2, 3), 12, 8
_PAD = max(WIDTHS) - 1
_WORDS = re.compile(r"[^\W\d_]+")
_CHUNK, _CACHE_LIMIT = 1 << 16, 100_000
_LEARNT = "doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 <> 2"
_TABLES = ((1 << WORD_BITS) + 1, (1 << STEM_BITS) + 1)


class _Ids(dict):
    """word -> word row << 32 | stem row."""

    def __missing__(self, word: str) -> int:
        if len(self) > _CACHE_LIMIT:
            self.clear()
        w = zlib.crc32(word.encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)
        s = zlib.crc32(b"^" + word[:STEM].encode("utf-8", "surrogatepass")) & ((1 << STEM_BITS) - 1)
        self[word] = i = w << 32 | s
        return i


def word_ids(text: str | None, cache: dict) -> np.ndarray:
    """Ids of the words of a whole text; a text without words has one padding word."""
    words = _WORDS.findall((text or "").lower())
    return np.fromiter(map(cache.__getitem__, words), np.int64, len(words)) if words else np.array([-1])


def _rows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pad = ids < 0
    return np.where(pad, 1 << WORD_BITS, ids >> 32), np.where(pad, 1 << STEM_BITS, ids & 0xFFFFFFFF)


@dataclass
class Model:
    """words, stems: embeddings, a zero row for padding last; conv: (2 * DIM, sum of widths * FILTERS)."""

    words: np.ndarray
    stems: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    out: float
    scale: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None
    thresholds: dict[str | None, float] = field(default_factory=dict)

    def embed(self, ids: np.ndarray) -> np.ndarray:
        w, s = _rows(ids)
        return np.concatenate([self.words[w], self.stems[s]], axis=1)

    def activations(self, e: np.ndarray) -> np.ndarray:
        """(positions, widths * FILTERS) of a padded sequence; the last _PAD positions are void."""
        y, n, k, out = e @ self.conv, len(e) - _PAD, 0, []
        for w in WIDTHS:
            a = y[:n, k : k + FILTERS].copy()
            for o in range(1, w):
                a += y[o : n + o, k + o * FILTERS : k + (o + 1) * FILTERS]
            out.append(a)
            k += w * FILTERS
        return np.concatenate(out, axis=1)

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """Largest activation of each filter over each whole text, in chunks of _CHUNK words."""
        best = np.full((len(texts), len(self.bias)), -np.inf, np.float32)
        pad = np.full(_PAD, -1)
        spans = [(i, s, min(s + _CHUNK, len(t))) for i, t in enumerate(texts) for s in range(0, len(t), _CHUNK)]
        k = 0
        while k < len(spans):
            parts, starts, owners, size = [], [], [], 0
            while k < len(spans) and (not parts or size + spans[k][2] - spans[k][1] + _PAD <= _CHUNK + _PAD):
                i, s, e = spans[k]
                tail = texts[i][e : e + _PAD]  # a later chunk's first words, where a filter reaches over
                parts += [texts[i][s:e], tail, pad[: _PAD - len(tail)]]
                starts += [size, size + e - s]
                owners.append(i)
                size += e - s + _PAD
                k += 1
            a = self.activations(self.embed(np.concatenate([*parts, pad])))
            np.maximum.at(best, owners, np.maximum.reduceat(np.vstack([a, a[-1:]]), starts, axis=0)[::2])
        return np.maximum(best + self.bias, 0)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        z = (self.pooled(texts).astype(np.float64) * self.dense).sum(axis=1) + self.out
        return np.rint(np.clip(z, -64, 64) * LOGIT_STEPS) / LOGIT_STEPS

    def flat(self) -> np.ndarray:
        """All weights as rows of DIM: words, stems, then the rest, padded."""
        rest = np.concatenate([self.conv.ravel(), self.bias, self.dense, [self.out]]).astype(np.float32)
        return np.concatenate([self.words, self.stems, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> Model:
        words, stems, rest = np.split(flat, np.cumsum(_TABLES))
        shape, k = (2 * DIM, sum(WIDTHS) * FILTERS), len(WIDTHS) * FILTERS
        conv, bias, dense, out = np.split(rest.ravel(), np.cumsum([shape[0] * shape[1], k, k]))
        return cls(words.copy(), stems.copy(), conv.reshape(shape).copy(), bias.copy(), dense.copy(), float(out[0]))

    def on_grid(self) -> Model:
        """Weights as multiples of powers of two, small enough for a filter's sum to be exact in single precision: then
        activations don't depend on the order of additions, and so on which texts share a batch."""
        self.words, self.stems = (np.clip(np.rint(t * 32), -256, 256).astype(np.float32) / 32 for t in (self.words, self.stems))
        self.conv = np.clip(np.rint(self.conv * 128), -512, 512).astype(np.float32) / 128
        return self

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return _sigmoid(self.scale[0] * self.logits(texts).astype(np.float64) + self.scale[1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _count(n: np.ndarray, pos: np.ndarray, ids: np.ndarray, weight: float, positive: float) -> None:
    """Adds a text to the numbers of rows, and of positive rows, that hold each word and stem."""
    for own, size in zip(_rows(ids), (0, _TABLES[0]), strict=True):
        u = np.unique(own) + size
        n[u] += weight
        pos[u] += positive


def _log_odds(n: np.ndarray, pos: np.ndarray, base: float, shrink: float = 16.0) -> np.ndarray:
    p = (pos + shrink * base) / (n + shrink)
    return np.where(n > 0, np.clip(np.log(p / (1 - p)) - np.log(base / (1 - base)), -4, 4), 0)


def _start(n: np.ndarray, pos: np.ndarray, base: float, rng: np.random.Generator) -> Model:
    """The untrained model from the counts of the training texts, whose share of label 1 is ``base``."""
    tables = []
    for own_n, own_pos in zip(np.split(n, [_TABLES[0]]), np.split(pos, [_TABLES[0]]), strict=True):
        t = np.zeros((len(own_n), DIM), np.float32)
        seen = np.flatnonzero(own_n)
        t[seen, 1:] = rng.normal(0, 0.05, (len(seen), DIM - 1))
        t[:, 0] = _log_odds(own_n, own_pos, base)
        t[-1] = 0
        tables.append(t)
    k = len(WIDTHS) * FILTERS
    conv = rng.normal(0, 0.1, (2 * DIM, sum(WIDTHS) * FILTERS))
    conv[0, :: FILTERS // 3] += 0.5
    conv[DIM, :: FILTERS // 3] += 0.5
    return Model(*tables, conv.astype(np.float32), np.zeros(k, np.float32), rng.normal(0.05, 0.1, k).astype(np.float32), float(np.log(base / (1 - base))))


class _Adam:
    """Adam on the logistic loss of ``m``; through max pooling each filter learns from its best position only."""

    def __init__(self, m: Model, rate: float):
        self.m, self.rate, self.steps = m, rate, 0
        self.first = {n: (np.zeros_like(getattr(m, n)), np.zeros_like(getattr(m, n))) for n in ("conv", "bias", "dense")}
        self.out_m = self.out_v = 0.0

    def step(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        """One step on a batch; ``y`` is the share of label 1 among a row's labels, ``weight`` their number."""
        m, rate, pad = self.m, self.rate, np.full(_PAD, -1)
        starts_of = np.cumsum([0, *WIDTHS])[:-1] * FILTERS
        self.steps += 1
        step = self.steps
        ids, at, n = [], [], 0
        for t in texts:
            ids += [t, pad]
            at.append((n, n + len(t)))
            n += len(t) + _PAD
        ids = np.concatenate([*ids, pad])
        e = m.embed(ids)
        a = m.activations(e)
        where = np.array([s + a[s:t].argmax(axis=0) for s, t in at])  # (texts, filters)
        h = np.maximum(np.take_along_axis(a, where, axis=0) + m.bias, 0)
        err = weight * (_sigmoid(h @ m.dense + m.out) - y) / weight.sum()
        g = {"dense": h.T @ err, "bias": None, "conv": np.zeros_like(m.conv)}
        gh = np.outer(err, m.dense) * (h > 0)
        g["bias"] = gh.sum(axis=0)
        rows, grads = [], []
        for wi, w in enumerate(WIDTHS):
            cols = slice(wi * FILTERS, (wi + 1) * FILTERS)
            for o in range(w):
                c = slice(starts_of[wi] + o * FILTERS, starts_of[wi] + (o + 1) * FILTERS)
                pos = where[:, cols] + o
                g["conv"][:, c] = np.einsum("bfd,bf->df", e[pos], gh[:, cols])
                rows.append(pos.ravel())
                grads.append((gh[:, cols, None] * m.conv[:, c].T[None]).reshape(-1, 2 * DIM))
        rows, grads = np.concatenate(rows), np.concatenate(grads)
        w, s = _rows(ids[rows])
        live = ids[rows] >= 0
        np.subtract.at(m.words, w[live], (rate * 5 * grads[live, :DIM]).astype(np.float32))
        np.subtract.at(m.stems, s[live], (rate * 5 * grads[live, DIM:]).astype(np.float32))
        for name, (m1, m2) in self.first.items():
            m1 += 0.1 * (g[name] - m1)
            m2 += 0.001 * (g[name] ** 2 - m2)
            getattr(m, name)[...] -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        go = err.sum()
        self.out_m, self.out_v = self.out_m + 0.1 * (go - self.out_m), self.out_v + 0.001 * (go * go - self.out_v)
        m.out -= rate * (self.out_m / (1 - 0.9**step)) / (np.sqrt(self.out_v / (1 - 0.999**step)) + 1e-8)


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = 4, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> Model:
    """All rows on the driver, in another order in each epoch."""
    rng, n, pos = np.random.default_rng(seed), np.zeros(sum(_TABLES)), np.zeros(sum(_TABLES))
    for t, own in zip(texts, y, strict=True):
        _count(n, pos, t, 1, own)
    m = _start(n, pos, y.mean(), rng)
    adam = _Adam(m, rate)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), batch):
            own = order[lo : lo + batch]
            adam.step([texts[i] for i in own], y[own], np.ones(len(own)))
    return m.on_grid()


def _platt(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, float]:
    """Scale and offset of the logistic curve over ``x``, by damped Newton steps on smoothed targets; a
    pull to (1, 0) keeps them finite where the classes are apart. ``n``: how many rows each entry stands for."""
    n = np.ones(len(x)) if n is None else n
    t = np.where(y > 0, ((n * y).sum() + 1) / ((n * y).sum() + 2), 1 / ((n * (1 - y)).sum() + 2))
    f, ab = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        z = f @ v
        return float((n * (np.logaddexp(0, z) - t * z)).sum() + ((v - [1, 0]) ** 2).sum())

    for _ in range(50):
        p = _sigmoid(f @ ab)
        step = np.linalg.solve((f * (n * p * (1 - p))[:, None]).T @ f + 2 * np.eye(2), f.T @ (n * (p - t)) + 2 * (ab - [1, 0]))
        while loss(ab - step) > loss(ab) and np.abs(step).max() > 1e-9:
            step /= 2
        ab = ab - step
    return float(max(ab[0], 0.05)), float(ab[1])


def _thresholds(score: np.ndarray, y: np.ndarray, langs: list, least: int = LEAST, n: np.ndarray | None = None) -> dict[str | None, float]:
    """For each language with ``least`` rows of both classes the cut of the best F1, halfway to the next
    score, pulled to THRESHOLD where cuts tie. ``n``: how many rows each entry stands for."""
    n, out = np.ones(len(y)) if n is None else n, {}
    for lang in set(langs):
        own = np.array([x == lang for x in langs])
        s, t, k = score[own], y[own], n[own]
        if min((k * t).sum(), (k * (1 - t)).sum()) < least:
            continue
        u, at = np.unique(s, return_inverse=True)
        cuts = np.concatenate([(u[1:] + u[:-1]) / 2, [THRESHOLD]])
        caught, taken = (np.append(np.bincount(at, v)[::-1].cumsum()[::-1], 0)[np.searchsorted(u, cuts)] for v in (k * t, k))  # of scores at the cut and above
        f1 = 2 * caught / np.maximum(1, taken + (k * t).sum())
        best = cuts[f1 == f1.max()]
        out[lang] = float(best[np.abs(best - THRESHOLD).argmin()])
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256))


def _collector():
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Ids()
        for part in _parts(batches):
            ids = [word_ids(t.as_py(), cache) for t in part.column(3)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "toxic", "lang", "n", "ids"])

    return collect


def _usable(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(f"toxic IN (0, 1) AND {_LEARNT}")


def _slim(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text")


def _sample(docs: DataFrame, labels: DataFrame, max_labelled: int, max_words: int):
    """doc_id, toxic, lang and word ids of labelled rows, bounded in rows and words; ``fit`` uses them if they are all."""
    sample = _usable(labels).orderBy(F.md5(F.col("doc_id").cast("string")), "toxic").limit(max_labelled)
    joined = _slim(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "lang", "text")  # max_labelled rows of two numbers
    found = joined.mapInArrow(_collector(), "doc_id long, toxic int, lang string, n long, ids binary")
    found = materialize(found.withColumn("at", F.monotonically_increasing_id()), "labelled")
    order = (F.md5(F.col("doc_id").cast("string")), "toxic", "n", "at")
    first = found.select("doc_id", "toxic", "n", "at").orderBy(*order).limit(max_labelled)  # ids may repeat without bound
    so_far = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = first.withColumn("so_far", so_far).filter(F.col("so_far") <= max_words).select("at")  # max_labelled rows
    return found.join(F.broadcast(chosen), "at", "left_semi").select("doc_id", "toxic", "lang", "ids").toPandas().sort_values(["doc_id", "toxic", "ids"])


def _held_out(ids: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of a fifth of the ids of each class, one at least; none where a class has a single id."""
    held: set[int] = set()
    for c in (0, 1):
        own = sorted(set(ids[y == c].tolist()), key=lambda i: (zlib.crc32(f"cal{i}".encode()), i))
        if len(own) < 2:
            return np.zeros(len(ids), bool)
        held.update(own[: max(1, len(own) // 5)])
    cal = np.isin(ids, list(held))
    return cal if len(set(y[~cal].tolist())) == 2 else np.zeros(len(ids), bool)  # an id may bear both labels


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, text, n0 and n1 (its labels 0 and 1) of every labelled document."""
    counts = _usable(labels).groupBy("doc_id").agg(F.sum(1 - F.col("toxic")).alias("n0"), F.sum("toxic").alias("n1"))
    return _slim(docs).filter(_LEARNT).join(counts.hint("merge"), "doc_id")


def _likely(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without most of those that no label names, by a bit table of label ids: the join shuffles less text. A
    table at its largest lets more through, never fewer than there are."""
    usable = _usable(labels)
    bits = 1 << min(_MAX_LABEL_BITS, (16 * usable.count()).bit_length())
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    own = usable.select(at.alias("bit")).selectExpr("bit div 64 AS at", "shiftleft(1L, int(bit % 64)) AS bit")
    found = own.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64 + 1, np.int64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def labelled(at: pa.Array) -> pa.Array:
        i = at.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[i >> 6] >> (i & 63)) & 1 == 1)

    return docs.filter(F.arrow_udf(labelled, "boolean")(at))


def _sharded(labelled: DataFrame, shards: int) -> DataFrame:
    """shard, doc_id, lang, n0, n1 and word ids; a shard's rows lie together, in the order of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Ids()
        for b in _parts(batches):
            ids = pa.array([word_ids(t.as_py(), cache).tobytes() for t in b.column(5)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], ids], names=["shard", "doc_id", "lang", "n0", "n1", "ids"])

    own = labelled.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "lang", "n0", "n1", "text")
    own = own.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("text", "doc_id"))
    return materialize(own.mapInArrow(run, "shard int, doc_id long, lang string, n0 long, n1 long, ids binary"), "labelled", "zstd")


def _held_rule(rows: DataFrame):
    """Whether a row calibrates: about a fifth of the ids of each class, one at least, by a hash; None where that leaves a
    class without ids on either side. An id with a label 1 is of class 1."""
    bucket = F.shiftright(F.crc32(F.concat(F.lit("cal"), F.col("doc_id").cast("string"))), 32 - _BUCKET_BITS)
    ids = rows.groupBy("doc_id").agg((F.max("n1") > 0).alias("toxic")).groupBy("toxic", bucket.cast("int").alias("bucket")).count().toArrow()
    toxic, at, n = (np.asarray(ids.column(c).to_numpy()) for c in ("toxic", "bucket", "count"))
    cuts = {}
    for c in (False, True):
        up_to = np.bincount(at[toxic == c], n[toxic == c], 1 << _BUCKET_BITS).cumsum()
        cuts[c] = int(np.searchsorted(up_to, max(1, up_to[-1] // 5)))
        if up_to[-1] < 2 or up_to[cuts[c]] == up_to[-1]:
            return None
    held = bucket <= F.when(F.col("n1") > 0, cuts[True]).otherwise(cuts[False])
    left = rows.filter(~held).agg(F.sum("n0"), F.sum("n1")).first()
    return held if left[0] and left[1] else None


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many rows, and how many of label 1, hold each word and stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pos = np.zeros(sum(_TABLES), np.int64), np.zeros(sum(_TABLES), np.int64)
        for b in _parts(batches):
            for n0, n1, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                _count(n, pos, np.frombuffer(ids, np.int64), n0 + n1, n1)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen]), pa.array(pos[seen])], names=["at", "n", "pos"])

    got = rows.select("n0", "n1", "ids").mapInArrow(run, "at long, n long, pos long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toArrow()
    out = np.zeros((2, sum(_TABLES)))
    out[:, got.column("at").to_numpy()] = got.column("n").to_numpy(), got.column("pos").to_numpy()
    return out[0], out[1]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """shard, texts, n0 and n1 of BATCH rows at a time; the last ones of a shard may be fewer."""

    def piece() -> tuple[int, list[np.ndarray], np.ndarray, np.ndarray]:
        return shard, [np.frombuffer(r[2], np.int64) for r in held], np.array([r[0] for r in held], float), np.array([r[1] for r in held], float)

    shard, held = None, []
    for b in _parts(batches):
        for own, *r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if held and (own != shard or len(held) == BATCH):
                yield piece()
                held = []
            shard = own
            held.append(r)
    if held:
        yield piece()


def _round(rows: DataFrame, start: Model) -> Model:
    """Every shard trains on from ``start``; the mean of their moves, by steps. A weight that few shards move takes the
    mean of theirs."""
    shared = rows.sparkSession.sparkContext.broadcast(start)
    names = [f"d{i}" for i in range(DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, last, adam = shared.value.flat(), None, None
        moves = np.zeros((len(base), DIM + 1), np.int64)

        def add(adam: _Adam) -> None:
            move = adam.m.flat() - base
            at = np.flatnonzero(move.any(axis=1))
            moves[at, :DIM] += adam.steps * np.rint(move[at].astype(float) * _MOVE_STEPS).astype(np.int64)
            moves[at, DIM] += adam.steps

        for shard, texts, n0, n1 in _pieces(batches):
            if shard != last:
                if adam:
                    add(adam)
                last, adam = shard, _Adam(Model.from_flat(base), RATE)
            adam.step(texts, n1 / (n0 + n1), n0 + n1)
        if adam:
            add(adam)
        at = np.flatnonzero(moves[:, DIM])
        for i in range(0, len(at), 4096):
            own = at[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(c) for c in moves[own].T.copy())], names=["at", *names, "steps"])

    found = rows.select("shard", "n0", "n1", "ids").mapInArrow(run, f"at long, {', '.join(f'{c} long' for c in names)}, steps long")
    got = found.groupBy("at").agg(*(F.sum(c).alias(c) for c in (*names, "steps"))).toArrow()
    shared.destroy()
    flat, steps = start.flat(), got.column("steps").to_numpy()
    flat[got.column("at").to_numpy()] += np.stack([got.column(c).to_numpy() / steps / _MOVE_STEPS for c in names], axis=1).astype(np.float32)
    return Model.from_flat(flat)


def _calibrate(m: Model, held: DataFrame) -> None:
    """Scale, offset and thresholds by the counts of all rows of ``held`` by language and logit."""
    shared = held.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            x = shared.value.logits([np.frombuffer(t.as_py(), np.int64) for t in b.column(3)])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(x)], names=["lang", "n0", "n1", "x"])

    def entries(t) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, n0, n1 = (np.asarray(t[c], float) for c in ("x", "n0", "n1"))
        return np.concatenate([x, x]), np.repeat([0.0, 1.0], len(x)), np.concatenate([n0, n1])

    sums = [F.sum(c).alias(c) for c in ("n0", "n1")]
    counts = held.select("lang", "n0", "n1", "ids").mapInArrow(run, "lang string, n0 long, n1 long, x double").groupBy("lang", "x").agg(*sums)
    counts = materialize(counts, "logits")
    m.scale = _platt(*entries(counts.groupBy("x").agg(*sums).orderBy("x").toArrow()))
    scale = m.scale

    def cut(t):
        x, y, n = entries(t)
        got = _thresholds(_sigmoid(scale[0] * x + scale[1]), y, [True] * len(x), n=n)
        return t[["lang"]].head(len(got)).assign(cut=list(got.values()))

    m.thresholds = {r["lang"]: r["cut"] for r in counts.groupBy("lang").applyInPandas(cut, "lang string, cut double").collect()}


def _fit_on_executors(labelled: DataFrame, docs: int, shard_rows: int, rounds: int) -> Model:
    rows = _sharded(labelled, -(-docs // shard_rows))
    held = _held_rule(rows)
    trained = rows if held is None else rows.filter(~held)
    n0, n1 = trained.agg(F.sum("n0"), F.sum("n1")).first()
    m = _start(*_counts(trained), n1 / (n0 + n1), np.random.default_rng(SEED))
    for _ in range(rounds):
        m = _round(trained, m)
    m.on_grid()
    if held is not None:
        _calibrate(m, rows.filter(held))
    return m


def _constant(share: float) -> Model:
    return Model(*[np.zeros((1, DIM), np.float32)] * 2, *[np.zeros(0, np.float32)] * 3, 0.0, constant=share)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_words: int = MAX_WORDS, shard_rows: int = SHARD_ROWS, rounds: int = ROUNDS) -> Model:
    """Train on all labelled rows whose crc32(id) mod 4 isn't 2; a fifth of their ids calibrates. Beyond ``max_labelled``
    rows or ``max_words`` words executors train."""
    ship(docs.sparkSession)
    n, n0, n1 = _labelled(docs, labels).agg(F.count("*"), F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    if not n0 or not n1:
        return _constant(n1 / max(1, n0 + n1))
    got = _sample(docs, labels, max_labelled, max_words) if n0 + n1 <= max_labelled else ()
    if len(got) < n0 + n1:
        return _fit_on_executors(_labelled(_likely(docs, labels), labels), n, shard_rows, rounds)
    texts, y = [np.frombuffer(b, np.int64) for b in got["ids"]], got["toxic"].to_numpy(float)
    held = _held_out(got["doc_id"].to_numpy(), y)
    m = train([t for t, c in zip(texts, held, strict=True) if not c], y[~held])
    if held.any():
        x = m.logits([t for t, c in zip(texts, held, strict=True) if c]).astype(float)
        m.scale = _platt(x, y[held])
        m.thresholds = _thresholds(_sigmoid(m.scale[0] * x + m.scale[1]), y[held], got["lang"][held].tolist())
    return m


def _batch_scores(m: Model, column: pa.Array, cache: dict) -> np.ndarray:
    out, block, size = [], [], 0
    for cell in column:
        block.append(t := word_ids(cell.as_py(), cache))
        size += len(t)
        if size >= 4 * _CHUNK:
            out.append(m.scores(block))
            block, size = [], 0
    return np.concatenate([*out, m.scores(block)]) if block or not out else np.concatenate(out)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, threshold (of the document's language), rejected, for every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # its size depends on WORD_BITS and STEM_BITS alone
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, _Ids()
        for b in batches:
            s = _batch_scores(m, b.column(2), cache)
            cut = np.array([m.thresholds.get(x.as_py(), THRESHOLD) for x in b.column(1)], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), pa.array(cut), pa.array(s >= cut)], names=["doc_id", "score", "predicted", "threshold", "rejected"])

    slim = docs.select("doc_id", lang.alias("lang"), "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, score double, predicted int, threshold double, rejected boolean")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` below their language's threshold, all columns unchanged."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, _Ids()
        for b in batches:
            cut = np.array([m.thresholds.get(x.as_py(), THRESHOLD) for x in b.column(lang)] if lang is not None else [THRESHOLD] * b.num_rows, float)
            yield b.filter(pa.array(_batch_scores(m, b.column(text), cache) < cut))

    return docs.mapInArrow(run, docs.schema)
