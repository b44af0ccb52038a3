"""Media columns: Netpbm and BMP images as binary columns.

``decode`` turns stored bytes into a numpy array, ``area_resize`` shrinks it exactly with an integral
image, ``difference_hash`` fingerprints the 9x8 tile and ``npy_bytes`` writes the tile as NPY.
``store_payloads`` wraps arbitrary bytes losslessly as the samples of a grey image, ``media_features``
reads stored images back.

Defined results: a null payload counts as empty; an empty payload is one image of padding; equal payloads
give equal images and hashes; an image that cannot be decoded gives null features; repeated rows and null
keys are kept as they are; an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes, batch, bounded_batches, each, pick, written

#: Payloads are padded to a multiple of this many samples, 24 x 24.
TILE_SAMPLES = 576
ROW = 24
PAD = b"\xff"

MEDIA = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema(
    [
        ("key", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()), ("feature", pa.string()), ("height", pa.int64()), ("width", pa.int64()), ("tile", pa.binary()),
    ]
)


def _fields(data: bytes, count: int, at: int) -> tuple[list[int], int]:
    """``count`` decimal header fields from ``at``, with # comments skipped; the offset after the last digit."""
    out: list[int] = []
    while len(out) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = (data.find(b"\n", at) + 1 or len(data)) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a header field is missing")
        if end - at > 10:
            raise ValueError("an impossible header field")
        out.append(int(data[at:end]))
        at = end
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as ``uint8`` or ``uint16``: (height, width), or (height, width, 3) for pixmaps. Bitmaps give 0 or 255."""
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456":
        raise ValueError("not a Netpbm image")
    bitmap, plain, planes = kind in b"14", kind in b"123", 3 if kind in b"36" else 1
    head, at = _fields(data, 2 if bitmap else 3, 2)
    width, height, top = head[0], head[1], 1 if bitmap else head[2]
    if not width or not height or not 0 < top < 65536:
        raise ValueError("an impossible size or maximum")
    n = width * height * planes
    if plain:
        body = data[at:]
        # A sample of more than five digits is beyond any maximum.
        values = np.array([c - 48 for c in body if c in b"01"] if bitmap else [int(x) if x.isdigit() and len(x.lstrip(b"0")) <= 5 else -1 for x in body.split()], np.int64)[:n]
    elif bitmap:
        packed = np.frombuffer(data, np.uint8, height * -(-width // 8), at + 1)
        values = np.unpackbits(packed.reshape(height, -1), axis=1)[:, :width].ravel()
    else:
        values = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if values.size != n:
        raise ValueError("samples are missing")
    if values.min() < 0 or (not bitmap and values.max() > top):
        raise ValueError("a sample is beyond the maximum")
    if bitmap:
        values = (1 - values.astype(np.int64)) * 255
    out = values.astype(np.uint16 if top > 255 else np.uint8)
    return out.reshape((height, width, 3) if planes == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits with a palette, or 24 or 32 bits: (height, width) if grey, else (height, width, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    start, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing or bits not in (8, 24, 32) or width <= 0 or not height or head < 40:
        raise ValueError("an unsupported BMP")
    rows, stride = abs(height), (width * bits // 8 + 3) & ~3
    raw = np.frombuffer(data, np.uint8, rows * stride, start).reshape(rows, stride)[:: -1 if height > 0 else 1, : width * bits // 8]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        if used > 256 or int(raw.max()) >= used:
            raise ValueError("a colour is not in the palette")
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        colours = palette[raw]
        return colours[:, :, 0] if (palette == palette[:, :1]).all() else colours
    return raw.reshape(rows, width, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    """The image that ``data`` holds, by its first bytes."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (struct.error, OverflowError, IndexError) as e:  # sizes and offsets that no file has
        raise ValueError(f"not a readable image: {e}") from e


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit grey BMP, rows from the bottom."""
    height, width = samples.shape
    padded = np.zeros((height, (width + 3) & ~3), np.uint8)
    padded[:, :width] = samples
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 1078 + padded.size, 0, 0, 1078, 40, width, height, 1, 8, 0, padded.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + padded[::-1].tobytes()


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's exact area: the integral image, interpolated at fractional edges."""
    grey = image.astype(np.float64)
    grey = grey.mean(axis=2) if grey.ndim == 3 else grey
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)

    def at(edges: np.ndarray, axis: int, of: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(np.int64), of.shape[axis] - 2)
        part = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return of.take(low, axis) * (1 - part) + of.take(low + 1, axis) * part

    rows, cols = np.linspace(0, grey.shape[0], height + 1), np.linspace(0, grey.shape[1], width + 1)
    corners = at(cols, 1, at(rows, 0, total))
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return np.clip(np.rint(sums / (grey.shape[0] / height * (grey.shape[1] / width))), 0, 65535)


def difference_hash(tile: np.ndarray) -> str:
    """64 bits of an 8 x 9 tile, one for each pair of neighbours in a row: is the left one brighter?"""
    return np.packbits((tile[:, :-1] > tile[:, 1:]).ravel()).tobytes().hex()


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def payload_image(payload: bytes) -> bytes:
    """``payload`` padded with 255 and kept as the samples of a grey image, 24 to a row."""
    short = -len(payload) % TILE_SAMPLES if payload else TILE_SAMPLES
    padded = payload + PAD * short
    return encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, ROW))


def store_payloads(df: DataFrame, key: str, payload: str) -> DataFrame:
    """A written table (key, n_bytes, media) with one image for each row of ``df``."""
    bounded_batches(df.sparkSession)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in each(batches, key, payload):
            data = [x or b"" for x in as_bytes(texts)]
            yield batch(MEDIA, key=keys, n_bytes=[len(x) for x in data], media=[payload_image(x) for x in data])

    return written(pick(df, key, payload).mapInArrow(images, "key long, n_bytes long, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """Reads every stored image of (key, n_bytes, media): digests of samples and file, size, NPY tile, difference hash."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sizes, stored in each(batches, "key", "n_bytes", "media"):
            out: dict[str, list] = {f.name: [] for f in FEATURES}
            out |= {"key": keys, "n_bytes": sizes}
            for data in stored.to_pylist():
                try:
                    image = decode(data or b"")
                except ValueError:
                    image = None
                samples = None if image is None else image.tobytes()
                tile = None if image is None else area_resize(image, 8, 9).astype(image.dtype)
                row = {
                    "payload_bytes": samples and len(samples), "payload_sha256": samples and hashlib.sha256(samples).hexdigest(), "tail_crc32": samples and zlib.crc32(samples[-32:]),
                    "media_bytes": None if data is None else len(data), "media_sha256": None if data is None else hashlib.sha256(data).hexdigest(), "feature": None if tile is None else difference_hash(tile),
                    "height": None if image is None else image.shape[0], "width": None if image is None else image.shape[1], "tile": None if tile is None else npy_bytes(tile),
                }
                for name, value in row.items():
                    out[name].append(value)
            yield batch(FEATURES, **out)

    return media.mapInArrow(
        features, "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height long, width long, tile binary"
    )
