"""Media columns: Netpbm and BMP images decoded to numpy, area-resized and kept as NPY tiles with hashes.

Decoders: Netpbm P1 to P6 (plain and raw, 8 and 16 bits, comments) and uncompressed BMP (1, 4, 8, 24 and 32
bits, either row order). ``area_resize`` averages exact areas from an integral image, so any size shrinks or
grows without sampling. ``difference_hash`` compares neighbours of a 9 x 8 grey tile. ``tiles`` makes a
column of NPY bytes that ``numpy.load`` reads.

``payload_features`` stores arbitrary bytes losslessly as the 8-bit samples of a raw PGM, 576 to a row, reads
the stored bytes back by the decoder, and digests them.

Defined cases: a null or empty text is one row of padding; a null image gives null in every column, and bytes
that are no image of these kinds give null tiles and an ``error``; equal inputs give equal values; texts of
any length are stored whole; extra columns are ignored by ``payload_features`` and kept by ``tiles``.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

WIDTH, TAIL, HASH_W, HASH_H, _BAND = 576, 32, 9, 8, 1024
_FIELD = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([0-9]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.astype(np.uint8).tobytes()


def encode_bmp(rgb: np.ndarray) -> bytes:
    """24-bit BMP, bottom row first."""
    h, w, _ = rgb.shape
    stride = (3 * w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : 3 * w] = rgb[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3); bitmaps as 0 (black) and 1."""
    kind = data[1] - 48
    if data[:1] != b"P" or not 1 <= kind <= 6:
        raise ValueError("no Netpbm image")
    at, fields = 2, []
    while len(fields) < (2 if kind in (1, 4) else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("damaged Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    w, h, top = fields[0], fields[1], (fields[2:] or [1])[0]
    if not 0 < top < 65536 or w * h == 0:
        raise ValueError("damaged Netpbm header")
    depth = 3 if kind in (3, 6) else 1
    if kind in (1, 2, 3):
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        flat = np.array([int(c) for c in (re.findall(rb"[01]", body) if kind == 1 else body.split())][: w * h * depth], np.uint16 if top > 255 else np.uint8)
    elif kind == 4:
        stride = (w + 7) // 8
        flat = np.unpackbits(np.frombuffer(data, np.uint8, h * stride, at + 1).reshape(h, stride), axis=1)[:, :w].ravel()
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * depth, at + 1)
    if flat.size != w * h * depth:
        raise ValueError("truncated Netpbm image")
    if kind in (1, 4):
        flat = 1 - flat
    return flat.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """(h, w, 3) in red, green, blue."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("no BMP image")
    (start,) = struct.unpack_from("<I", data, 10)
    size, w, h, _, bits, packed, _, _, _, colours, _ = struct.unpack_from("<IiiHHIIiiII", data, 14)
    if packed or bits not in (1, 4, 8, 24, 32) or w <= 0 or h == 0:
        raise ValueError("unsupported BMP image")
    rows, stride = abs(h), (bits * w + 31) // 32 * 4
    if len(data) < start + rows * stride:
        raise ValueError("truncated BMP image")
    body = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)
    if bits >= 24:
        rgb = body[:, : w * bits // 8].reshape(rows, w, bits // 8)[:, :, 2::-1]
    else:
        palette = np.frombuffer(data, np.uint8, 4 * (colours or 1 << bits), 14 + size).reshape(-1, 4)
        per = 8 // bits
        index = body if bits == 8 else np.stack([(body >> (bits * (per - 1 - i))) & ((1 << bits) - 1) for i in range(per)], axis=2).reshape(rows, -1)
        rgb = palette[index[:, :w]][:, :, 2::-1]
    return np.ascontiguousarray(rgb[::-1] if h > 0 else rgb)


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area, from the integral image (sums stay exact for integer samples).

    The integral image is made ``_BAND`` rows at a time, and only its rows beside a cell's edge are kept.
    """
    h, w = image.shape[:2]
    at = np.arange(height + 1) * h / height
    lo = np.minimum(at.astype(int), h - 1)
    need = np.unique(np.concatenate([lo, lo + 1]))
    kept = np.zeros((len(need), w, *image.shape[2:]))
    above = np.zeros((1, w, *image.shape[2:]))
    for top in range(0, h, _BAND):
        sums = above + image[top : top + _BAND].cumsum(axis=0, dtype=np.float64)
        own = np.nonzero((need > top) & (need <= top + len(sums)))[0]
        kept[own] = sums[need[own] - top - 1]
        above = sums[-1:]
    total = np.zeros((len(need), w + 1, *image.shape[2:]))
    total[:, 1:] = kept.cumsum(axis=1)
    part = (at - lo).reshape([-1] + [1] * (image.ndim - 1))
    rows = total[np.searchsorted(need, lo)] * (1 - part) + total[np.searchsorted(need, lo + 1)] * part
    across = np.arange(width + 1) * w / width
    left = np.minimum(across.astype(int), w - 1)
    share = (across - left).reshape([1, -1] + [1] * (image.ndim - 2))
    grid = rows[:, left] * (1 - share) + rows[:, left + 1] * share
    return np.diff(np.diff(grid, axis=0), axis=1) / (h / height * w / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits, one for each cell that is darker than its right neighbour in a 9 x 8 grey tile."""
    return _darker(area_resize(grey(image), HASH_H, HASH_W))


def _darker(cells: np.ndarray) -> str:
    small = np.round(cells, 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def _tiler(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for cell in b.column(b.num_columns - 1):
                data = cell.as_py()
                try:
                    if data is None:
                        rows.append((None,) * 5)
                        continue
                    image = decode(data)
                    tile = np.clip(np.rint(area_resize(image, side, side)), 0, 65535 if image.dtype.itemsize > 1 else 255).astype(image.dtype.newbyteorder("="))
                    rows.append((image.shape[1], image.shape[0], npy(tile), difference_hash(image), None))
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((None, None, None, None, str(e) or "damaged image"))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*b.schema.names, "width", "height", "tile", "dhash", "error"])

    return run


def tiles(images: DataFrame, image_col: str = "image", id_col: str = "id", side: int = 32) -> DataFrame:
    """id, image, width, height, tile (NPY bytes of side x side samples), dhash, error."""
    ship(images.sparkSession)
    slim = images.select(F.col(id_col).alias("id"), F.col(image_col).alias("image"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(_tiler(side), f"id {kind}, image binary, width int, height int, tile binary, dhash string, error string")


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % WIDTH if data else WIDTH), len(data)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_bytes, media: the stored form of each text, some rows at a time."""
    for b in batches:
        for i in range(0, b.num_rows, 512):
            part = b.slice(i, 512)
            got = [padded(t.as_py()) for t in part.column(1)]
            media = [encode_pgm(np.frombuffer(p, np.uint8).reshape(-1, WIDTH)) for p, _ in got]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in got], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for cell in b.column(2):
            media = cell.as_py()
            image = decode(media)
            cells = area_resize(image, HASH_H, HASH_W)
            tail = image[-1, -TAIL:].tobytes()
            out.append((image.size, hashlib.sha256(image).hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), _darker(cells), npy(np.rint(cells).astype(np.uint8))))
        cols = list(zip(*out, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", *_NAMES])


_NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile")


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a raw PGM of 576 samples a row."""
    ship(docs.sparkSession)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_store, f"doc_id {slim.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def payload_features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold when they are read back; ``feature`` is the difference hash, ``tile`` the NPY bytes of
    the 9 x 8 means that it comes from."""
    ship(media.sparkSession)
    slim = media.select("doc_id", "n_bytes", "media")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_features, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
