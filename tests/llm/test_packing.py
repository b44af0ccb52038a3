"""Token pieces against the tokenizers library; packings against their invariants and the least possible number of sequences."""

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from seqlytics.llm import packing


def test_ids_equal_the_tokenizers_library(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["Hello world", "", "  two  blanks \n\n", "été ß 東京 123abc!!", "a" * 5000, "<|endoftext|>", None, "word " * 9000]
    texts += ["a<|endoftext|>b", "x <|endoftext|> y  <|endoftext|>\n<|endoftext|><|endoftext|>", "<|endoftext", "".join(map(chr, range(1, 0x250))), "\u00a0\u3000\u200b 1²½ \ufffd", "I'LL we'll 'S's"]
    with open("/root/testdata/sf0.001/documents.parquet", "rb") as f:
        texts += pq.read_table(f, columns=["text"])["text"].to_pylist()
    assert 50256 in other.encode(texts[8], add_special_tokens=False).ids
    got = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for i, t in enumerate(texts):
        ids = [*other.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == i)
        assert [p[0] for p in pieces] == list(range(len(pieces)))
        assert sum(p[2] for p in pieces) == len(ids) and all(p[2] == 2048 for p in pieces[1:])
        for _, start, n, crc in pieces:
            assert crc == zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("island", [64, 4096])
def test_packings_are_whole_and_tight(spark, island):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 400, 1500)
    df = spark.createDataFrame([(int(i), int(n), int(rng.integers(1 << 60))) for i, n in enumerate(lengths)], "doc_id long, length long, deal long")
    got = packing.pack(df, capacity=1000, island=island).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1500))
    assert check(got, 1000) <= 1.03 * -(-int(lengths.sum()) // 1000)


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 900, 300)
    sizes = lengths.tolist()
    a, b = packing.Bins(sizes, 1000), packing.Bins(sizes, 1000)
    a.best_fit(list(range(300)))
    b.best_fit(rng.permutation(300)[:150].tolist())
    b.best_fit([i for i in range(300) if i not in {x for bin_ in b.bins for x in bin_}])
    child = packing.crossover(a, b, 0.5, rng)
    assert sorted(x for bin_ in child.bins for x in bin_) == list(range(300))
    for items, free in zip(child.bins, child.free, strict=True):
        assert sum(sizes[i] for i in items) == 1000 - free >= 0


def test_evolution_beats_or_equals_best_fit():
    rng = np.random.default_rng(6)
    lengths = np.sort(rng.integers(200, 700, 400))[::-1]
    plain = packing.Bins(lengths.tolist(), 1000)
    plain.best_fit(list(range(400)))
    assert len(packing.evolve(lengths, 1000)) <= len(plain.bins)
    with pytest.raises(ValueError):
        packing.evolve(np.array([1001]), 1000)


def test_ties_in_length(spark):
    df = spark.createDataFrame([(i, 500, 7) for i in range(1000)], "doc_id long, length long, deal long")
    got = packing.pack(df, capacity=1000, island=100).collect()
    assert check(got, 1000) == 500 and sorted(r["doc_id"] for r in got) == list(range(1000))


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "same"), (1, "same"), (None, None)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, length long")
    got = packing.pack_documents(df).collect()
    assert len(got) == 3 and check(got, 2048) == 1
    assert packing.pack_documents(df.limit(0)).collect() == []
