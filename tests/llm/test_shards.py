"""Near equal leaves, gapless slots, copies together."""

import zlib

import pytest
from pyspark.sql import functions as F

from seqlytics.llm import shards


def dims():
    return {"chars": F.length("text"), "lang": F.xxhash64("lang") % 1000}


def test_leaves_are_near_equal(spark):
    rows = [(i, "x" * (i * 37 % 400), f"l{i % 3}") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = shards.kd_shards(df, "doc_id", "text", dims(), shards=8).collect()
    assert sorted(r["key"] for r in got) == list(range(4000))
    total = [0] * 8
    slots = [[] for _ in range(8)]
    for r in got:
        assert r["size"] == len(rows[r["key"]][1]) + 1 and r["text_crc32"] == zlib.crc32(rows[r["key"]][1].encode())
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(total) < 1.03 * min(total)
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_small_groups_of_copies_stay_together(spark):
    rows = [(i, f"text {i // 4} " * 20, "l") for i in range(8000)]
    got = shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", dims(), shards=8).collect()
    where = {}
    for r in got:
        where.setdefault(r["key"] // 4, set()).add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) == 0


def test_a_large_group_is_split(spark):
    rows = [(i, "same text", None) for i in range(900)] + [(i, None, "x") for i in range(900, 1000)] + [(None, "y", "x")]
    got = shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", dims(), shards=4).collect()
    total = [0] * 4
    for r in got:
        total[r["shard"]] += r["size"]
    assert len(got) == 1001 and max(total) - min(total) < 0.05 * sum(total)


def test_target_bytes_odd_counts_and_empty(spark):
    df = spark.createDataFrame([(i, "x" * 99, "l") for i in range(300)], "doc_id long, text string, lang string").withColumn("shard", F.lit(1)).withColumn("size", F.lit(2))
    got = shards.kd_shards(df, "doc_id", "text", dims(), target_bytes=10_000).groupBy("shard").count().collect()
    assert sorted(r["shard"] for r in got) == [0, 1, 2] and all(95 <= r["count"] <= 105 for r in got)
    assert shards.kd_shards(df.limit(0), "doc_id", "text", dims(), shards=8).collect() == []
    few = shards.kd_shards(df.limit(2), "doc_id", "text", dims(), shards=8).collect()
    assert len(few) == 2


def brute(rows, dims, leaves, slack=0.002):
    """Plain recursion over sorted lists: (key, node) of rows (key, size, text_hash, row_hash, dims...)."""
    whole = {d: max(r[d] for r in rows) - min(r[d] for r in rows) for d in dims}

    def at(part, key, want, total):
        """How many of the rows, in order, go left."""
        run = 0
        groups = {}
        for r in part:
            groups.setdefault(key[0](r), []).append(r)
        n = 0
        for v in sorted(groups):
            size = sum(r["size"] for r in groups[v])
            if run + size >= want or v == max(groups):
                short, over = want - run, run + size - want
                if len(key) == 1 or min(short, over) <= slack * total:
                    return n + (len(groups[v]) if over <= short else 0)
                return n + at(sorted(groups[v], key=key[1]), key[1:], want - run, total)
            run, n = run + size, n + len(groups[v])
        return n

    def cut(part, label, k):
        if k == 1 or not part:
            return [(r["key"], label) for r in part]
        spread = lambda d: ((max(r[d] for r in part) - min(r[d] for r in part)) / (whole[d] or 1), d)
        d = max(dims, key=spread)
        order = [lambda r: r[d], lambda r: r["text_hash"], lambda r: r["row_hash"]]
        part = sorted(part, key=lambda r: tuple(f(r) for f in order))
        total = sum(r["size"] for r in part)
        n = at(part, order, total * (k // 2) / k, float(total))
        return cut(part[:n], label, k // 2) + cut(part[n:], label + k // 2, k - k // 2)

    return sorted(cut(rows, 0, leaves))


@pytest.mark.parametrize(("leaves", "bounds", "nodes"), [(8, 1 << 14, 1000), (37, 16, 1000), (16, 64, 0), (1, 16, 5)])
def test_cuts_equal_brute_force(spark, monkeypatch, leaves, bounds, nodes):
    """Ties, groups of copies and a very long text; few bounds, so many rounds; nodes joined and broadcast."""
    monkeypatch.setattr(shards, "BOUNDS", bounds)
    monkeypatch.setattr(shards, "BROADCAST_NODES", nodes)
    rows = [(i, f"t{i % 40} " * (i * 13 % 29), f"l{i % 5}") for i in range(300)] + [(500 + i, "copy " * 9, "l1") for i in range(90)] + [(900, "y" * 50_000, "l2"), (901, None, None), (902, "", "l0")]
    sized = shards.sized(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", dims())
    want = brute([r.asDict() for r in sized.collect()], ["dim_chars", "dim_lang"], leaves)
    assert sorted((r["key"], r["shard"]) for r in shards.split(sized, leaves).collect()) == want


def test_plans_do_not_grow_with_the_leaves(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 97), "l") for i in range(600)], "doc_id long, text string, lang string")
    sized = shards.sized(rows, "doc_id", "text", dims())
    sizes = [len(shards.split(sized, n)._jdf.queryExecution().toString()) for n in (8, 64)]
    assert sizes[1] < 1.2 * sizes[0]
