"""The join against all pairs, compared by brute force."""

import random
import re
from pathlib import Path

import numpy as np
import pytest

from seqlytics.llm import jaccard
from seqlytics.llm.common import as_bytes  # noqa: F401  (the subpackage imports as a whole)
from seqlytics.sources.scratch import scratch_path


def brute(rows, n, percent):
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.setdefault(doc, []).append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if d is not None)
    degree = dict.fromkeys(sets, 0)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = sorted((root(a), root(b)))
                        parent[q] = p
                        degree[a] += 1
                        degree[b] += 1
    return {d: (sorted(map(len, s)), root(d), degree[d]) for d, s in sets.items()}


def corpus(seed, documents=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for i in range(documents):
        kind = rng.random()
        if kind < 0.35 and rows:
            text = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(4)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(words)
        elif kind < 0.6:
            text = passage[: rng.randrange(5, 30)] + [rng.choice(words) for _ in range(rng.randrange(12))]
        else:
            text = [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 7, 9, 12, 18, 25, 90, 300]))]
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 4, 85), (3, 5, 80), (4, 2, 60)])
def test_components_equal_brute_force(spark, seed, n, percent):
    rows = corpus(seed)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n=n, percent=percent).collect()
    want = brute(rows, n, percent)
    assert len(got) == len(rows)
    assert {r["doc"]: ([r["n_shingles"]], r["component_id"], r["n_links"]) for r in got} == want


@pytest.mark.parametrize(("sets", "shingles", "columns"), [(3, 1 << 18, 4096), (512, 500, 64)])
def test_links_are_counted_across_blocks(spark, monkeypatch, sets, shingles, columns):
    """One group of near copies, in many blocks: no link between different texts is lost, though few pairs were compared to connect them."""
    rng = random.Random(8)
    base = [f"x{i}" for i in range(60)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(len(text))] = f"y{rng.randrange(9)}"
        rows.append((i, " ".join(text)))
    rows += [(100 + i, rows[i % 7][1].upper()) for i in range(40)] + [(300, " ".join(f"z{i}" for i in range(3000))), (301, " ".join(f"z{i}" for i in range(2990)))]
    for name, value in (("LINK_SETS", sets), ("LINK_SHINGLES", shingles), ("LINK_COLUMNS", columns)):
        monkeypatch.setattr(jaccard, name, value)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc"]: ([r["n_shingles"]], r["component_id"], r["n_links"]) for r in got} == brute(rows, 4, 85)


def test_group_of_copies_is_linked_through_leaders(spark):
    base = " ".join(f"x{i}" for i in range(80))
    rows = [(i, base if i % 2 else base + f" tail{i}") for i in range(400)]
    _, links = jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert links.count() < 3 * len(rows)
    assert {r["component"] for r in jaccard.components(links).collect()} == {0}


@pytest.mark.parametrize(
    "links",
    [
        [],
        [(2, 1), (1, 2), (3, 3), (1, 5)],
        [(1, 4), (4, 2), (4, 3)],
        [(i, i + 1) for i in range(37)],
        [(i * 17 % 41, (i + 1) * 17 % 41) for i in range(40)],
        [(9, 5), (9, 1), (5, 7), (20, 21), (22, 21), (30, 31)],
        [tuple(map(int, x)) for x in np.random.default_rng(5).integers(0, 150, (110, 2))],
    ],
)
def test_components_of_any_graph(spark, links):
    parent = {x: x for link in links for x in link if link[0] != link[1]}
    for _ in parent:
        for a, b in links:
            if a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    got = [(r["doc"], r["component"]) for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert sorted(got) == sorted(parent.items())


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "A b", 5), (3, "a B", 5), (4, "a b", 5), (None, "a b", 5), (7, "  \n\t", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc long").withColumnRenamed("doc", "component")
    got = sorted(((r["doc"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (4, 1, 3), (None, 1, None), (7, 0, 7)], key=str)


def test_scratch_tables_go_when_their_last_reader_is_written(spark):
    def tables():
        return set(Path(scratch_path(spark, "x")).parent.glob("*"))

    before = tables()
    rows = corpus(5)
    found = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {p.name.rpartition("-")[0] for p in tables() - before} <= {"sizes", "links", "edges", "members", "set-links"}
    for _ in range(2):  # nothing that is left to compute reads what is gone
        assert {r["doc"]: ([r["n_shingles"]], r["component_id"], r["n_links"]) for r in found.collect()} == brute(rows, 4, 85)


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_subsets_and_prefixes_share_a_key_whenever_sets_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 14))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 60, int(rng.integers(0, 2))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 85 * (len(a) + len(b) - common):
            assert set(jaccard.subset_keys(a, 85).tolist()) & set(jaccard.subset_keys(b, 85).tolist())
            k, m = jaccard.prefix_length(len(a), 85), jaccard.prefix_length(len(b), 85)
            assert set(a[:k].tolist()) & set(b[:m].tolist())
            apart = sum(int(x ^ y).bit_count() for x, y in zip(jaccard.sketch(a).view(np.uint64).tolist(), jaccard.sketch(b).view(np.uint64).tolist(), strict=True))
            assert apart <= len(a) + len(b) - 2 * common


def test_light_bound_weighs_both_costs():
    assert jaccard.light_bound({}, 85, 2.0) == 0
    assert jaccard.light_bound({8: 1000}, 85, 50.0) >= 8
    assert jaccard.light_bound({20: 1000}, 85, 1.0) < 20


def test_long_sketches_bound_the_difference(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for i in range(40):
        a = np.unique(rng.integers(0, 1 << 60, int(rng.integers(520, 3000))).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 60, int(rng.integers(0, 90))).astype(np.uint64)]))
        rows.append((i, jaccard.long_sketch(a).tolist(), jaccard.long_sketch(b).tolist()))
        want.append(len(np.setxor1d(a, b)))
    from pyspark.sql import functions as F

    got = spark.createDataFrame(rows, "i int, a array<long>, b array<long>").select("i", jaccard.apart_in_long(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        assert want[r["i"]] * 0.5 < r["d"] <= want[r["i"]]
