"""Byte-level BPE over length-bucketed, padded numpy matrices.

Distinct pieces are sorted by length into buckets and become rows of a padded matrix of ids. Each
round, every row merges its leftmost pair of minimum rank; pair ranks come from an open-addressing
hash table held in numpy arrays; merged cells are squeezed out and finished rows leave the matrix.
A piece that is a vocabulary entry as a whole is that token at once. A piece longer than
``MATRIX_WIDTH`` bytes is a row of its own, without padding; as one round for each merge would cost its length
squared, a round makes all merges of the minimum rank that come before any pair of lower rank.

What a worker remembers of pieces is bounded in bytes (``_REMEMBERED``), not only in number.

Defined cases: a null text is the empty text: no ids, empty bytes; pieces of any length are encoded
whole; documents repeat freely; columns other than the text pass through or are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

MATRIX_WIDTH, CELLS = 256, 1 << 19
NONE = np.int32(2**31 - 1)
_EMPTY, _MULT = np.uint64(2**64 - 1), np.uint64(0x9E3779B97F4A7C15)
_REMEMBERED, _ENTRY = 48 << 20, 200  # bytes of remembered pieces; of an entry besides its text and ids


class PairTable:
    """(left id, right id) -> rank of the merged token, by vectorised open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(rank) + 4))))
        self.mask = np.uint64((1 << self.bits) - 1)
        self.keys, self.ranks = np.full(1 << self.bits, _EMPTY, np.uint64), np.full(1 << self.bits, NONE, np.int32)
        keys, rank = self._key(left, right), rank.astype(np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # keys that want a free slot race for it; the losers move on by one
            free = self.keys[slot[todo]] == _EMPTY
            want = todo[free]
            self.keys[slot[want]] = keys[want]
            won = want[self.keys[slot[want]] == keys[want]]
            self.ranks[slot[won]] = rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MULT) >> np.uint64(64 - self.bits)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks in the shape of ``left``; NONE where no token joins the pair or an id is padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        at = np.nonzero((left >= 0) & (right >= 0))
        keys = self._key(left[at], right[at])
        slot, ranks, todo = self._slot(keys), np.full(len(keys), NONE, np.int32), np.arange(len(keys))
        while len(todo):
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            ranks[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (there != _EMPTY)]
            slot[todo] = (slot[todo] + np.uint64(1)) & self.mask
        out[at] = ranks
        return out


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {i: t for t, i in ranks.items()}
        self.name = {i: b"%d" % i for i in self.token}
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        left, right, rank = (array("i") for _ in range(3))
        for token, r in ranks.items():
            for i in range(1, len(token)):
                x, y = ranks.get(token[:i]), ranks.get(token[i:])
                if x is not None and y is not None:
                    left.append(x)
                    right.append(y)
                    rank.append(r)
        self.pairs = PairTable(*(np.frombuffer(v, np.int32) if v else np.empty(0, np.int32) for v in (left, right, rank)))

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if p in self.ranks:
                out[i] = [self.ranks[p]]
            elif len(p) > MATRIX_WIDTH:
                out[i] = self._by_row(p)
            elif p:
                buckets.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(i)
        for width, at in buckets.items():
            step = max(1, CELLS // width)
            for i in range(0, len(at), step):
                self._by_matrix(pieces, at[i : i + step], width, out)
        return out

    def _by_matrix(self, pieces: list[bytes], at: list[int], width: int, out: list[list[int]]) -> None:
        flat = np.frombuffer(b"".join(pieces[i] for i in at), np.uint8)
        lengths = np.array([len(pieces[i]) for i in at])
        cells = np.full((len(at), width), -1, np.int32)
        cells[np.arange(width) < lengths[:, None]] = self.byte[flat]
        ranks = np.full((len(at), width), NONE, np.int32)  # of the pair that begins in a cell
        ranks[:, :-1] = self.pairs.get(cells[:, :-1], cells[:, 1:])
        own = np.array(at)
        while len(own):
            j = ranks.argmin(axis=1)  # the leftmost of equal minima
            r = np.arange(len(own))
            best = ranks[r, j]
            done = best == NONE
            if done.any():
                for k in np.nonzero(done)[0]:
                    out[own[k]] = cells[k][cells[k] >= 0].tolist()
                go = ~done
                cells, ranks, own, j, best = cells[go], ranks[go], own[go], j[go], best[go]
                r = np.arange(len(own))
                if not len(own):
                    break
            cells[r, j] = best
            keep = np.ones(cells.shape, bool)
            keep[r, j + 1] = False
            used = max(1, int((cells >= 0).sum(axis=1).max()) - 1)
            cells, ranks = (m[keep].reshape(len(own), -1)[:, : used + 1] for m in (cells, ranks))  # squeezed by one cell
            cells, ranks = np.ascontiguousarray(cells), np.ascontiguousarray(ranks)
            ranks[r, j] = NONE
            last = cells.shape[1] - 1
            for col in (j - 1, j):
                ok = np.nonzero((col >= 0) & (col < last))[0]
                ranks[ok, col[ok]] = self.pairs.get(cells[ok, col[ok]], cells[ok, col[ok] + 1])

    def _by_row(self, piece: bytes) -> list[int]:
        """The same merges for a row of its own: a round takes the minimum rank's places from the left on, as long as no
        merge makes a pair of lower rank, which would come next. So rounds number about the distinct ranks of a
        piece, not its length."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.get(ids[:-1], ids[1:])  # of the pair that begins in a cell
        while len(ranks) and (best := ranks.min()) != NONE:
            at = np.nonzero(ranks == best)[0]
            if len(at) > 1 and (np.diff(at) == 1).any():  # places that overlap ("aaa"): in each run every other one, from its first on
                run = np.concatenate([[0], np.cumsum(np.diff(at) != 1)])
                start = at[np.searchsorted(run, run)]
                at = at[(at - start) % 2 == 0]
            # the pairs that each merge makes at its moment: with a merge just to the left, but not yet one to the right
            left = np.where(at > 0, ids[at - 1], -1)
            touching = np.nonzero(np.diff(at) == 2)[0] + 1
            left[touching] = best
            right = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
            new = np.full(len(at), best, np.int32)
            lower = np.minimum(self.pairs.get(left, new), self.pairs.get(new, right)) < best
            if lower.any():
                at = at[: int(lower.argmax()) + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids[at] = best
            moved = np.cumsum(keep) - 1
            ranks = np.append(ranks, NONE)[keep][:-1]
            ids, at = ids[keep], moved[at]
            for col in (at - 1, at):
                ok = col[(col >= 0) & (col < len(ranks))]
                ranks[ok] = self.pairs.get(ids[ok], ids[ok + 1])
        return ids.tolist()

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, text: str | None) -> list[int]:
        found = self.encode_pieces([p.encode() for p in self.split(text or "")])
        return [i for ids in found for i in ids]

    def decode(self, ids: Iterable[int] | np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))

    def ids_digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids with a space between."""
        return hashlib.sha256(b" ".join(map(self.name.__getitem__, ids.tolist()))).hexdigest()


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def _model(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE.load(path, pattern)
    return _LOADED[path, pattern]


class _Pieces(dict):
    """piece -> its ids as int32 bytes. When half of the bound is full, what wasn't asked for since it was half full the
    last time goes."""

    def __init__(self) -> None:
        super().__init__()
        self.size, self.older = 0, {}

    def learn(self, model: ByteBPE, pieces: set[str]) -> None:
        """Have all of ``pieces``; new ones are encoded together."""
        if self.size > _REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
            self.size = 0
        fresh = []
        for p in pieces:
            if p not in self:
                if p in self.older:
                    self._put(p, self.older[p])
                else:
                    fresh.append(p)
        for p, ids in zip(fresh, model.encode_pieces([p.encode() for p in fresh]), strict=True):
            self._put(p, np.array(ids, np.int32).tobytes())

    def _put(self, piece: str, ids: bytes) -> None:
        self[piece] = ids
        self.size += _ENTRY + len(piece) + len(ids)


def _ids_of(model: ByteBPE, known: _Pieces, texts: list[str]) -> Iterator[np.ndarray]:
    """The ids of each text; new pieces of all texts are encoded together."""
    parts = [model.split(t) for t in texts]
    known.learn(model, set().union(*parts))
    for pieces in parts:
        yield np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.int32)


def _blocks(column: pa.Array, chars: int = 1 << 20) -> Iterator[list[str]]:
    """The texts of a column in lists of about so many characters; null is empty."""
    block, size = [], 0
    for cell in column:
        block.append(text := cell.as_py() or "")
        size += len(text)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _digester(path: str, pattern: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = _model(path, pattern), _Pieces()
        for batch in batches:
            n, ids, decoded = [], [], []
            for texts in _blocks(batch.column(1)):
                for own in _ids_of(model, known, texts):
                    n.append(len(own))
                    ids.append(model.ids_digest(own))
                    decoded.append(hashlib.sha256(model.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def _encoder(path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = _model(path, pattern), _Pieces()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = [ids for texts in _blocks(part.column(part.num_columns - 1)) for ids in _ids_of(model, known, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, pa.list_(pa.int32()))], names=[*part.schema.names[:-1], "ids"])

    return encode


def _decoder(path: str, pattern: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path, pattern)
        for batch in batches:
            out = [None if (ids := cell.as_py()) is None else model.decode(ids) for cell in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], names=[*batch.schema.names[:-1], "bytes"])

    return decode


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every document."""
    ship(docs.sparkSession)
    slim = docs.select(id_col, text_col)
    return slim.mapInArrow(_encoder(path, pattern), f"`{id_col}` {slim.schema[0].dataType.simpleString()}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary); null ids give null."""
    ship(encoded.sparkSession)
    slim = encoded.select(id_col, ids_col)
    return slim.mapInArrow(_decoder(path, pattern), f"`{id_col}` {slim.schema[0].dataType.simpleString()}, bytes binary")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded whole and its ids decoded again."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_digester(path, pattern), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
