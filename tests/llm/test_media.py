"""Round trips, and resizing against plain means."""

import hashlib
import io
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest

from seqlytics.llm import media


def test_netpbm_kinds():
    assert media.decode_netpbm(b"P2\n# c\n3 2\n9\n1 2 3\n4 5 9\n").tolist() == [[1, 2, 3], [4, 5, 9]]
    assert media.decode_netpbm(b"P1 2 2\n10\n01").tolist() == [[0, 255], [255, 0]]
    assert media.decode_netpbm(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode_netpbm(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode_netpbm(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    for bad in (b"", b"P9 1 1 1\n", b"P5 2 2 255\n\x00", b"P5 0 1 255\n", b"P5 x"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_bmp_round_trip():
    image = np.arange(35, dtype=np.uint8).reshape(5, 7) * 7
    assert (media.decode(media.encode_bmp(image)) == image).all()
    assert (media.decode(media.encode_pgm(image)) == image).all()


def test_area_resize_is_a_mean():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (24, 36)).astype(np.uint8)
    want = np.rint(image.reshape(8, 3, 9, 4).mean(axis=(1, 3)))
    assert (media.area_resize(image, 8, 9) == want).all()
    flat = np.full((5, 3), 77, np.uint8)
    assert (media.area_resize(flat, 8, 9) == 77).all()


def test_tile_and_hash():
    tile = np.tile(np.arange(9, 0, -1), (8, 1))
    assert media.difference_hash(tile) == "f" * 16
    assert (np.load(io.BytesIO(media.npy_bytes(tile))) == tile).all()


def test_store_and_read_back(spark):
    texts = [None, "", "x", "ü" * 288, "a" * 577, "long " * 100_000, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("z", "key")
    got = {r["key"]: r for r in media.media_features(media.store_payloads(df, "doc_id", "text")).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"]) == (len(data), len(payload))
        assert got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-32:])
        stored = media.payload_image(data)
        assert got[i]["media_sha256"] == hashlib.sha256(stored).hexdigest() and got[i]["media_bytes"] == len(stored)
        assert np.load(io.BytesIO(got[i]["tile"])).shape == (8, 9)
    assert got[2]["feature"] == got[6]["feature"]


def bmp_with(at: int, form: str, value: int) -> bytes:
    data = bytearray(media.encode_bmp(np.full((3, 3), 200, np.uint8)))
    struct.pack_into(form, data, at, value)
    return bytes(data)


BROKEN = [
    bmp_with(46, "<I", 100), bmp_with(46, "<I", 2**32 - 1), bmp_with(18, "<i", 2**31 - 1), bmp_with(22, "<i", -(2**31)), bmp_with(10, "<I", 2**32 - 1), bmp_with(14, "<I", 0), bmp_with(14, "<I", 2**32 - 1), b"BM", b"BM" + bytes(52),
    b"P2 1 1 255\n" + b"9" * 30, b"P2 1 1 9\n10", b"P2 1 1 9\n-1", b"P2 1 1 9\nx", b"P5 1 1 9\n\x0a", b"P5 99999999999999999999 1 255\n", b"P6 4000000000 4000000000 255\n", b"P3 1 1 255 1 2", b"P1 2 2 10", b"P4 9 9\n",
    b"P5 2 2 255", b"P5 #", b"P5\n" + b"7" * 5000,
]


@pytest.mark.parametrize("data", BROKEN)
def test_malformed_files_are_value_errors(data):
    with pytest.raises(ValueError):
        media.decode(data)


def test_malformed_files_are_rows(spark):
    rows = [(i, len(d), bytearray(d)) for i, d in enumerate(BROKEN)] + [(-1, 1, bytearray(media.payload_image(b"x")))]
    got = {r["key"]: r for r in media.media_features(spark.createDataFrame(rows, "key long, n_bytes long, media binary")).collect()}
    assert len(got) == len(rows) and all((r["feature"] is None) == (k >= 0) for k, r in got.items())
    assert all(r["media_bytes"] == len(BROKEN[k]) for k, r in got.items() if k >= 0)


def test_features_equal_plain_means(spark):
    """The hash against cell means in exact fractions, for images whose height no cell divides."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(32, 127, n))) for n in (1, 700, 3000, 9999)]
    got = {r["key"]: r["feature"] for r in media.media_features(media.store_payloads(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")).collect()}
    for i, t in enumerate(texts):
        data = t.encode() + b"\xff" * (-len(t) % 576)
        image = np.frombuffer(data, np.uint8).reshape(-1, 24).astype(int).tolist()
        n, bits = len(image), ""
        for y in range(8):
            row = []
            for x in range(9):
                total = Fraction(0)
                for r in range(n):
                    high = min(Fraction(n * (y + 1), 8), r + 1) - max(Fraction(n * y, 8), r)
                    if high > 0:
                        total += sum(image[r][c] * high * wide for c in range(24) if (wide := min(Fraction(24 * (x + 1), 9), c + 1) - max(Fraction(24 * x, 9), c)) > 0)
                row.append(round(total / (Fraction(n, 8) * Fraction(24, 9))))
            bits += "".join("1" if a > b else "0" for a, b in zip(row, row[1:], strict=False))
        assert got[i] == f"{int(bits, 2):016x}"


def test_undecodable_and_empty(spark):
    stored = spark.createDataFrame([(1, 3, bytearray(b"bad")), (2, 0, None)], "key long, n_bytes long, media binary")
    assert [r["feature"] for r in media.media_features(stored).collect()] == [None, None]
    assert media.store_payloads(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect() == []
