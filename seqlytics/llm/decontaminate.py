"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of digits, ASCII letters (lower-cased) and all code points from U+0080 on. An item of at least ``size`` words has
a window at each of its words but the last ``size - 1``; a shorter one is one window. Every task holds 64-bit hashes of the items' windows,
each with the place of one, and the items' words; a document's window whose hash is among them is compared with the words there, so there are no false hits.

Items are taken in blocks of at most ``block_words`` words, longer items in overlapping parts, each block broadcast alone; hits of earlier blocks travel with the rows.
A word takes some 45 bytes of a block, its letters included.

Defined results: null and empty texts have no words and no hits; an item without words has no windows; a null item id hits words but is not
counted or named; equal items with different ids are all named; repeated rows are scanned each; an empty table, or no items, gives no hits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from .common import as_bytes, batch, bounded_batches, mix64, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Upper case to lower case, everything that is in no word to a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if WORD.fullmatch(bytes([c])) else 32 for c in range(256))
BLOCK_WORDS = 1 << 20
#: Blocks that rows pass in one stage, each with a Python worker of its own.
CHAINED = 4
#: Places of the filter that is asked before the hashes, for each window.
FILTER = 8
ODD = np.uint64(0xD6E8FEB86659FD93)

#: Plain, so that it can be broadcast: the words, joined by blanks, with each one's first and last place; the items' ids; and for each length of windows
#: their sorted hashes, the place of the first word, the item, and the filter.
Windows = dict[str, Any]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each window of ``n`` words."""
    count = len(hashes) - n + 1
    out = np.full(max(0, count), n, np.uint64)
    for i in range(n if count > 0 else 0):
        out *= ODD
        out += hashes[i : i + count]
        out ^= out >> np.uint64(29)
    return mix64(out)


def word_places(words: list[bytes]) -> np.ndarray:
    """Where each word begins if they are joined by blanks, and where one behind the last would."""
    out = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=out[1:])
    return out


def build_windows(items: list[tuple[int | str | None, list[bytes]]], size: int) -> Windows:
    """The windows of items that are given as words. Of equal windows of one item one is held."""
    words = [w for _, own in items for w in own]
    hashes, at = word_hashes(words), 0
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for i, (_, own) in enumerate(items):
        n = min(size, len(own))
        if n:
            found = window_hashes(hashes[at : at + len(own)], n)
            by_length.setdefault(n, []).append((found, np.arange(at, at + len(found)), np.full(len(found), i)))
        at += len(own)
    lengths = {}
    for n, parts in by_length.items():
        found, place, item = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, item, found))
        found, place, item = found[order], place[order], item[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (item[1:] != item[:-1])
        found, place, item = found[new], place[new].astype(np.int32), item[new].astype(np.int32)
        seen = np.zeros(1 << (FILTER * len(found) - 1).bit_length(), bool)
        seen[found & np.uint64(len(seen) - 1)] = True
        lengths[n] = (found, place, item, seen)
    return {"text": b" ".join(words), "places": word_places(words), "ids": [None if i is None else str(i) for i, _ in items], "lengths": lengths}


def find_hits(words: list[bytes], windows: Windows) -> tuple[np.ndarray, set[str]]:
    """Which words lie in an occurrence of a window, and the ids of the items."""
    hit, items = np.zeros(len(words), bool), set()
    if not words or not windows["lengths"]:
        return hit, items
    hashes, joined, places = word_hashes(words), None, None
    text, theirs, ids = windows["text"], windows["places"], windows["ids"]
    for n, (known, place, item, seen) in windows["lengths"].items():
        own = window_hashes(hashes, n)
        near = np.flatnonzero(seen[own & np.uint64(len(seen) - 1)])
        left = np.searchsorted(known, own[near], "left")
        right = np.searchsorted(known, own[near], "right")
        for i, a, b in zip(near[left < right].tolist(), left[left < right].tolist(), right[left < right].tolist(), strict=True):
            if joined is None:
                joined, places = b" ".join(words), word_places(words)
            mine = joined[places[i] : places[i + n] - 1]
            for k in range(a, b):
                at = place[k]
                if text[theirs[at] : theirs[at + n] - 1] == mine:
                    hit[i : i + n] = True
                    if ids[item[k]] is not None:
                        items.add(ids[item[k]])
    return hit, items


def spans_of(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of the hit words; neighbours make one range with what lies between them."""
    out: list[list[int]] = []
    before = -2
    for i, m in enumerate(WORD.finditer(text.translate(TABLE))):
        if hit[i]:
            if before == i - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            before = i
    return [(a, b) for a, b in out]


def without(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without its hit words and what lies between neighbours of them."""
    left, at = [], 0
    for a, b in spans_of(text, hit):
        left.append(text[at:a])
        at = b
    return b"".join([*left, text[at:]])


def item_blocks(items: DataFrame, item: str, text: str, size: int, block_words: int) -> Iterator[list[tuple[int | str | None, list[bytes]]]]:
    """The items as words in driver-sized blocks; one block is on the driver at a time. An item of more words is cut into parts that share ``size`` - 1."""
    block: list[tuple[int | str | None, list[bytes]]] = []
    held, step = 0, max(1, block_words - size + 1)
    for row in items.select(F.col(f"`{item}`"), F.col(f"`{text}`")).toLocalIterator():
        words = words_of((row[1] or "").encode())
        for at in range(0, max(1, len(words) - size + 1), step) if len(words) > block_words else (0,):
            part = words[at : at + step + size - 1] if len(words) > block_words else words
            if block and held + len(part) > block_words:
                yield block
                block, held = [], 0
            block.append((row[0], part))
            held += len(part)
    yield block


STATE = StructType().add("key", LongType()).add("text", StringType()).add("n_words", LongType()).add("n_hit", LongType()).add("hit", BinaryType()).add("items", ArrayType(StringType()))
ARROW_STATE = pa.schema([("key", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.string()))])


def scan(
    df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 13, block_words: int = BLOCK_WORDS,
    keep_text: bool = True, others: tuple[str, ...] = (), cut: bool = False,
) -> DataFrame:
    """(key, text, n_words, n_hit, hit, items, and the columns ``others``): one bit for each word (packed), and the sorted ids of the items that occur.
    Without ``keep_text`` texts come back null. ``others`` must not be called like these. With ``cut`` contaminated documents are left out,
    and the hit spans are cut out of the texts of all others, in the same pass."""
    spark = df.sparkSession
    bounded_batches(spark)
    zero = F.lit(0).cast("long")
    start = [F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"), zero.alias("n_words"), zero.alias("n_hit"), F.lit(None).cast("binary").alias("hit"), F.array().cast("array<string>").alias("items")]
    out = df.select(*start, *[F.col(f"`{c}`") for c in others])
    schema = StructType([*STATE.fields, *out.schema.fields[len(STATE) :]])
    blocks = item_blocks(items, item, item_text, size, block_words)
    block: list | None = next(blocks)
    chained = 0
    while block is not None:
        after = next(blocks, None)
        shared, keep = spark.sparkContext.broadcast(build_windows(block, size)), keep_text or after is not None

        def find(batches: Iterator[pa.RecordBatch], shared=shared, keep=keep, cut=cut and after is None) -> Iterator[pa.RecordBatch]:
            windows = shared.value
            for whole in batches:
                keys, texts, _, _, hits, named, *rest = whole.columns
                n_words, n_hit, bits, ids, left = [], [], [], [], []
                for data, old, before in zip(as_bytes(texts), hits.to_pylist(), named.to_pylist(), strict=True):
                    words = words_of(data)
                    hit, found = find_hits(words, windows)
                    if old is not None:
                        hit |= np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                    n_words.append(len(words))
                    n_hit.append(int(hit.sum()))
                    bits.append(np.packbits(hit).tobytes())
                    ids.append(sorted(found | set(before)) if found else before)
                    if cut:
                        left.append(without(data, hit) if n_hit[-1] else data)
                if cut:
                    texts = pa.array(left, pa.binary()).cast(pa.string())
                state = batch(ARROW_STATE, key=keys, text=texts if keep else pa.nulls(len(texts), pa.string()), n_words=n_words, n_hit=n_hit, hit=bits, items=ids)
                out = pa.RecordBatch.from_arrays([*state.columns, *rest], names=whole.schema.names)
                yield out.filter(pa.array([not h or 20 * h < n for n, h in zip(n_words, n_hit, strict=True)], pa.bool_())) if cut else out

        out = out.mapInArrow(find, schema)
        chained += 1
        if after is not None and chained % CHAINED == 0:
            out = written(out, "scanned")
        block = after
    return out


def is_contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(scanned: DataFrame) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) from ``scan``."""
    return scanned.select("key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))
