"""Byte-level BPE against the tiktoken library, long pieces, decoding, defined cases."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from weftgraph.llm import bpe, queries
from weftgraph.llm.common import table

PATH, PATTERN = public_tokenizers.path(queries.TOKENIZER), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def theirs():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ours():
    return bpe.ByteBPE.load(PATH, PATTERN)


@pytest.mark.parametrize("text", ["", " ", "hello world", "Hello\n\n  World\t!", "don't I'LL we've", "größe 你好🙂🙂🙂", "a" * 3000, "ab" * 400, "x" * 257, "́‍ ﻿", "1234567890" * 30, "<|endoftext|>", "\x00\x7f"])
def test_texts(theirs, ours, text):
    assert ours.encode(text) == theirs.encode(text, disallowed_special=())
    assert ours.decode(ours.encode(text)) == text.encode()


def test_random_texts(theirs, ours):
    rng = random.Random(5)
    alphabet = "aaabbcde  \n\t'.,!0129éß你🙂̀ABZ"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(400)))
        assert ours.encode(text) == theirs.encode(text, disallowed_special=())


def test_matrix_and_rows_agree(ours, monkeypatch):
    rng = random.Random(6)
    pieces = [bytes(rng.choice(b"abcdest ing\xc3\xa9") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    by_matrix = ours.encode_pieces(pieces)
    monkeypatch.setattr(bpe, "MATRIX_WIDTH", 1)
    assert ours.encode_pieces(pieces) == by_matrix


def test_long_pieces(theirs, ours):
    """Pieces far beyond the matrix width, also with runs that overlap themselves."""
    rng = random.Random(16)
    for alphabet in ("ab", "aab", "abcdefghijklmnopqrstuvwxyz", "théing"):
        for n in (257, 1000, 30_000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert ours.encode(text) == theirs.encode(text, disallowed_special=())
    for text in ("a" * 50_000, "ab" * 20_000, "=" * 9_999):
        assert ours.encode(text) == theirs.encode(text, disallowed_special=())


def test_what_is_remembered_is_bounded(ours, monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 5_000)
    known, rng = bpe._Pieces(), random.Random(17)
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(40)) for _ in range(2)]
        assert [ids.tolist() for ids in bpe._ids_of(ours, known, texts)] == [ours.encode(t) for t in texts]
        assert known.size <= 2_500 + 2 * 80 * (bpe._ENTRY + 10 + 4 * 10)


def test_pair_table():
    rng = np.random.default_rng(7)
    keys = np.unique(rng.integers(0, 40, (600, 2)), axis=0)
    t = bpe.PairTable(keys[:, 0], keys[:, 1], np.arange(len(keys)))
    want = {tuple(k): i for i, k in enumerate(keys.tolist())}
    a, b = np.meshgrid(np.arange(-1, 45), np.arange(-1, 45))
    got = t.get(a.astype(np.int32), b.astype(np.int32))
    assert all(got[i, j] == want.get((a[i, j], b[i, j]), bpe.NONE) for i in range(46) for j in range(46))


def test_query(spark, sf_dir, theirs):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op7_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = theirs.encode(texts[r["doc_id"]], disallowed_special=())
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_defined_cases(odd_docs, no_docs, clashing, as_set):
    got = bpe.token_digests(odd_docs, PATH, PATTERN)
    assert got.count() == odd_docs.count()
    assert as_set(got) == as_set(bpe.token_digests(clashing(odd_docs), PATH, PATTERN))
    by_id = {r["doc_id"]: r for r in got.collect() if r["doc_id"]}
    assert by_id[3]["n_tokens"] == by_id[4]["n_tokens"] == 0
    assert by_id[3]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.token_digests(no_docs, PATH, PATTERN).count() == 0
    ids = bpe.encode_texts(odd_docs, PATH, PATTERN)
    back = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe.decode_ids(ids, PATH, PATTERN).collect() if r["doc_id"]}
    assert back == {r["doc_id"]: r["text"] or "" for r in odd_docs.collect() if r["doc_id"]}
    none = bpe.decode_ids(ids.selectExpr("doc_id", "cast(null AS array<int>) AS ids"), PATH, PATTERN)
    assert {r["bytes"] for r in none.collect()} == {None}
