"""Media: exact round trips, decoders, area resizing by brute force, hashes, tiles, defined cases."""

import hashlib
import io
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from weftgraph.llm import media, queries
from weftgraph.llm.common import table


def test_query_reads_back_every_text(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op6_media_columns(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        full = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(full))
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(full[-32:])
        stored = b"P5\n576 %d\n255\n" % (len(full) // 576) + full
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_padding():
    for n in (0, 1, 575, 576, 577):
        data, size = media.padded("x" * n)
        assert size == n
        assert len(data) == max(576, -(-n // 576) * 576)


def mean_of_area(image, height, width):
    h, w = image.shape
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            y0, y1, x0, x1 = i * h / height, (i + 1) * h / height, j * w / width, (j + 1) * w / width
            total = 0.0
            for y in range(h):
                for x in range(w):
                    total += image[y, x] * max(0, min(y + 1, y1) - max(y, y0)) * max(0, min(x + 1, x1) - max(x, x0))
            out[i, j] = total / ((y1 - y0) * (x1 - x0))
    return out


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (16, 9), (7, 23)])
@pytest.mark.parametrize("to", [(1, 1), (4, 4), (8, 9), (20, 30)])
def test_area_resize(shape, to):
    image = np.random.default_rng(1).integers(0, 256, shape)
    assert np.allclose(media.area_resize(image, *to), mean_of_area(image, *to))


def test_netpbm():
    ramp = np.arange(24, dtype=np.uint8).reshape(4, 6)
    assert (media.decode(media.encode_pgm(ramp)) == ramp).all()
    assert (media.decode(b"P2\n# note\n6 4 # more\n255\n" + " ".join(map(str, ramp.ravel())).encode()) == ramp).all()
    assert (media.decode(b"P5 6 4 999\n" + ramp.astype(">u2").tobytes()) == ramp).all()
    assert (media.decode(b"P3 1 2 255\n1 2 3 4 5 6") == [[[1, 2, 3]], [[4, 5, 6]]]).all()
    assert (media.decode(b"P6 1 2 255\n" + bytes(range(6))) == [[[0, 1, 2]], [[3, 4, 5]]]).all()
    assert (media.decode(b"P1\n3 2\n101\n0 1 0") == [[0, 1, 0], [1, 0, 1]]).all()
    assert (media.decode(b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])) == [[0, 1, 0], [1, 0, 1]]).all()


def test_bmp():
    rgb = np.random.default_rng(2).integers(0, 256, (5, 3, 3)).astype(np.uint8)
    data = media.encode_bmp(rgb)
    assert (media.decode(data) == rgb).all()
    body = data[54:]
    down = bytearray(data[:54])
    struct.pack_into("<i", down, 22, -5)
    assert (media.decode(bytes(down) + body) == rgb[::-1]).all()
    palette = b"".join(bytes([b, g, r, 0]) for r, g, b in ((1, 2, 3), (9, 8, 7)))
    head = b"BM" + struct.pack("<IHHI", 0, 0, 0, 62) + struct.pack("<IiiHHIIiiII", 40, 3, 1, 1, 1, 0, 0, 0, 0, 2, 0) + palette
    assert (media.decode(head + bytes([0b01000000, 0, 0, 0])) == [[[1, 2, 3], [9, 8, 7], [1, 2, 3]]]).all()


def test_difference_hash():
    ramp = np.tile(np.arange(90), (80, 1))
    assert media.difference_hash(ramp) == "f" * 16
    assert media.difference_hash(ramp[:, ::-1]) == "0" * 16
    assert media.difference_hash(np.full((5, 5), 7)) == "0" * 16


def test_tiles(spark):
    good = media.encode_pgm(np.arange(64, dtype=np.uint8).reshape(8, 8))
    rows = [(1, good), (2, None), (3, b"junk"), (4, b"P5 8 8 255\nxx"), (5, b""), (None, good)]
    got = {r["id"]: r for r in media.tiles(spark.createDataFrame(rows, "id long, image binary"), side=4).collect()}
    tile = np.load(io.BytesIO(bytes(got[1]["tile"])))
    assert tile.shape == (4, 4)
    assert tile[0, 0] in (4, 5)
    assert (got[1]["width"], got[1]["error"]) == (8, None)
    assert got[2]["tile"] is None
    assert got[2]["error"] is None
    assert all(got[i]["error"] for i in (3, 4, 5))
    assert got[None]["dhash"] == got[1]["dhash"]


def test_defined_cases(odd_docs, no_docs, clashing, as_set):
    got = media.payload_features(media.stored(odd_docs))
    assert got.count() == odd_docs.count()
    assert as_set(got) == as_set(media.payload_features(media.stored(clashing(odd_docs))))
    by_id = {r["doc_id"]: r for r in got.collect() if r["doc_id"]}
    assert by_id[3]["payload_sha256"] == by_id[4]["payload_sha256"]
    assert media.payload_features(media.stored(no_docs)).count() == 0


def test_query_reads_what_it_stored(spark, sf_dir):
    """The features come from written media, not from the documents in the same plan."""
    files = queries.op6_media_columns(spark, sf_dir).inputFiles()
    assert files
    assert all("/weftgraph/media-" in f for f in files)


def test_tiles_are_npy_and_hash_to_the_feature(spark):
    docs = spark.createDataFrame([(i, "".join(chr(33 + (i * j) % 90) for j in range(n))) for i, n in enumerate((1, 575, 577, 40_000), 1)], "doc_id long, text string")
    for r in media.payload_features(media.stored(docs)).collect():
        tile = np.load(io.BytesIO(r["tile"]), allow_pickle=False)
        assert (tile.shape, tile.dtype) == ((8, 9), np.uint8)
        assert len(r["feature"]) == 16


def test_resizing_keeps_few_rows(monkeypatch):
    """By bands of any height the same means, and no array of the image's own height."""
    rng = np.random.default_rng(12)
    image = rng.integers(0, 256, (5_000, 576), dtype=np.uint8)
    want = media.area_resize(image, 8, 9)
    assert np.allclose(want[0, 0], image[:625, :64].mean())
    for band in (1, 7, 624, 10_000):
        monkeypatch.setattr(media, "_BAND", band)
        assert np.array_equal(media.area_resize(image, 8, 9), want)
    monkeypatch.setattr(media, "_BAND", 256)
    tracemalloc.start()
    media.area_resize(image, 8, 9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * image.size
