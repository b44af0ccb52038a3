"""The scan against a plain search of all windows."""

import hashlib
import random
import re

from seqlytics.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, size=13):
    w = words(text)
    hit, ids = [False] * len(w), set()
    for item, t in items:
        v = words(t)
        n = min(size, len(v))
        for i in range(len(v) - n + 1) if v else []:
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit[j : j + n] = [True] * n
                    if item is not None:
                        ids.add(str(item))
    names = ",".join(sorted(ids))
    return len(w), sum(hit), len(ids), hashlib.sha256(names.encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(w)


def data(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(25)] + ["Ünï", "x9", "ß"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 30])))) for i in range(14)] + [(20, None), (None, "only null id"), (3, "w1 w1 w1")]
    docs = []
    for i in range(80):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if rng.random() < 0.6:
            piece = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(text) + 1)
            text[at:at] = piece if rng.random() < 0.7 else piece[1:]
        docs.append((i, rng.choice([" ", "\n", ", "]).join(text).upper() if rng.random() < 0.3 else " ".join(text)))
    return items, [*docs, (100, None), (101, ""), (None, "w1 w1 w1"), (5, "w1,w1-w1")]


def test_report_equals_brute_force(spark):
    for seed, block in ((1, d.BLOCK_WORDS), (2, 40), (3, 14), (4, 1)):  # many blocks of items in the second
        items, docs = data(seed)
        df = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, hit string")
        scanned = d.scan(df, spark.createDataFrame(items, "item_id long, text string"), block_words=block, keep_text=False)
        got = sorted(((r["key"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in d.report(scanned).collect()), key=str)
        assert got == sorted(((k, *brute(t, items)) for k, t in docs), key=str)


def test_clean_cuts_spans_and_drops_documents(spark):
    item = " ".join(f"q{i}" for i in range(13))
    long = " ".join(f"a{i}" for i in range(400))
    rows = [(1, f"{long}. {item.upper()}! {long}", "en"), (2, f"a b {item}", "en"), (3, None, "de"), (4, long, None)]
    for block in (d.BLOCK_WORDS, 1):
        items = spark.createDataFrame([(1, item), (2, "nothing here")], "item_id long, text string")
        cleaned = d.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string"), items, others=("lang",), cut=True, block_words=block)
        got = {r["key"]: (r["text"], r["lang"]) for r in cleaned.collect()}
        assert got == {1: (f"{long}. ! {long}", "en"), 3: (None, "de"), 4: (long, None)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in d.report(d.scan(df, none)).collect()] == [(1, 2, 0, 0)]
    assert d.report(d.scan(df.limit(0), none)).collect() == []


def test_long_texts_and_long_items(spark):
    """An item of many words in parts, a document of many words, a hot window that is in every item."""
    rng = random.Random(9)
    hot = " ".join(f"h{i}" for i in range(13))
    long = [f"v{rng.randrange(3000)}" for _ in range(5000)]
    items = [(1, " ".join(long))] + [(10 + i, f"{hot} x{i}") for i in range(50)]
    docs = [(1, " ".join(f"u{i}" for i in range(30_000)) + " " + " ".join(long[2480:2520])), (2, f"a {hot} b"), (3, " ".join(long[4987:])), (4, " ".join(long[4988:])), (5, f"{hot[:-1]} {hot[3:]}")]
    want = sorted((k, *brute(t, items)) for k, t in docs)
    for block in (d.BLOCK_WORDS, 1000):
        scanned = d.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block, keep_text=False)
        assert sorted(tuple(r) for r in d.report(scanned).collect()) == want


def test_a_block_takes_bounded_memory():
    """About 45 bytes a word, as the module says: the arrays and the text that are broadcast."""
    rng = random.Random(2)
    items = [(i, [b"w%d" % rng.randrange(50_000) for _ in range(500)]) for i in range(100)]
    windows = d.build_windows(items, 13)
    size = len(windows["text"]) + windows["places"].nbytes + sum(x.nbytes for parts in windows["lengths"].values() for x in parts)
    assert size < 55 * 50_000


def test_equal_hashes_are_no_hits(monkeypatch):
    """Windows that share a hash are told apart by their words."""
    monkeypatch.setattr(d, "window_hashes", lambda h, n: d.np.zeros(max(0, len(h) - n + 1), d.np.uint64))
    windows = d.build_windows([(1, [b"a", b"b", b"c"]), (2, [b"x", b"y", b"z"])], 3)
    hit, ids = d.find_hits([b"q", b"x", b"y", b"z", b"a", b"b"], windows)
    assert hit.tolist() == [False, True, True, True, False, False] and ids == {"2"}
