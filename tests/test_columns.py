"""Bits, runs, packed and sorted columns, permutations, four symbols, against naive answers."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from seqlytics.functions import words
from seqlytics.operators import bits, ordered, positions, runs, storage, suffix
from seqlytics.sources import scratch, store
from seqlytics.sources.scratch import written


def naive_runs(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            out.append((start, i))
            start = None
    return out


def rows_of(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, value long")


def test_bit_column_grows(spark):
    b = bits.BitColumn.empty(spark, 10).write({0: True, 9: True})
    assert str(b) == "1000000001" and b.length == 10
    assert bits.BitColumn.empty(spark, 10).write({4: False}).length == 5
    assert not b.access(5)
    for i in (-1, 10):
        with pytest.raises(IndexError):
            b.access(i)
        with pytest.raises(IndexError):
            b.write({i: True})


def test_bit_ranks_selects_and_cursor(spark):
    text = "011101100010"
    b = bits.BitColumn.of(spark, text)
    assert [b.rank1(p) for p in range(13)] == [text[:p].count("1") for p in range(13)] and b.rank0(12) == 6
    assert b.rank1_pair(2, 9) == (text[:2].count("1"), text[:9].count("1"))
    ones = [i for i, c in enumerate(text) if c == "1"]
    assert [b.select1_nth(k) for k in range(8)] == [-1, *ones, -1] and b.select0_nth(1) == 0
    inside = {r["pos"]: r["rank"] for r in bits.ranks_in_block(b.rows).collect()}
    assert inside == {p: text[:p].count("1") for p in range(12)}
    assert [b.select(True, k) for k in range(7)] == [*ones, -1] and b.select(False, 0) == 0 and b.select(True, -1) == -1
    assert list(b.cursor(True)) == ones
    got = {r["pos"]: tuple(r)[2:] for r in bits.bit_ranks(b.rows).collect()}
    assert got == {i: (text[:i].count("1"), text[:i].count("0"), text[: i + 1].count("1"), text[: i + 1].count("0")) for i in range(12)}


def test_bit_runs(spark):
    b = bits.BitColumn.of(spark, "01110110")
    tell = lambda df: sorted(map(tuple, df.collect()))
    assert tell(b.runs(True)) == [(1, 4), (5, 7)] and tell(b.runs(False)) == [(0, 1), (4, 5), (7, 8)]
    assert tell(b.runs(True, 2, 6)) == [(2, 4), (5, 6)] and tell(b.runs(True, 3, 3)) == []


@pytest.mark.parametrize("size", [1, 3, 64, 1 << 16])
def test_runs_across_blocks(spark, size):
    rng = random.Random(size)
    long = [7 if 127 <= i < 1023 or 2049 <= i <= 3900 else i % 7 for i in range(4096)]
    for values, low, high in (([1, 7, 7, 7, 1, 7, 7], 7, 7), ([1, 7, 5, 6, 1, 4, 7, 7, 3], 4, 7), ([rng.randrange(16) for _ in range(220)], 3, 11), (long, 7, 7)):
        got = sorted(map(tuple, runs.matching_runs(rows_of(spark, values), F.col("value").between(low, high), size=size).collect()))
        assert got == naive_runs([low <= v <= high for v in values])


def test_many_edges_take_the_distributed_way(spark, monkeypatch):
    rng = random.Random(9)
    values = [rng.random() < 0.8 for _ in range(400)]
    monkeypatch.setattr(runs, "few", lambda df: False)
    got = sorted(map(tuple, runs.matching_runs(rows_of(spark, list(map(int, values))), F.col("value") == 1, size=4).collect()))
    assert got == naive_runs(values)


def test_many_values_take_the_distributed_way(spark, monkeypatch):
    rows = spark.createDataFrame([(i * 7 % 101, i % 5 + 1) for i in range(101)], "x long, n long")
    want = {r["x"]: r["b"] for r in positions.sums_in_order(rows, ("x",), {"b": "n"}).collect()}
    monkeypatch.setattr(positions, "few", lambda df: False)
    assert {r["x"]: r["b"] for r in positions.sums_in_order(rows, ("x",), {"b": "n"}).collect()} == want


def test_level_counts(spark):
    rows = spark.range(20_000).select(F.col("id").alias("pos"), (F.col("id") % 3 == 0).alias("bit"))
    got = {r["block"]: (r["ones"], r["before"]) for r in bits.level_counts(rows, 1).collect()}
    ones = [sum(i % 3 == 0 for i in range(k * 512, min(20_000, (k + 1) * 512))) for k in range(40)]
    assert got == {k: (ones[k], sum(ones[k // 16 * 16 : k])) for k in range(40)}


def test_packed_column(spark):
    p = bits.PackedColumn(rows_of(spark, [1, 2, 3]), 3, 7)
    assert p.to_list() == [1, 2, 3] and bits.PackedColumn.of(p.rows, 2).n == 3
    for bad in (rows_of(spark, [1, 4]), spark.createDataFrame([(1, 1)], "pos long, value long")):
        with pytest.raises(ValueError):
            bits.PackedColumn.of(bad, 2)
    assert p.max_value == 127 and p.set(1, 127).get(1) == 127 and p.get(1) == 2 and str(p.fill(9)) == "@[9, 9, 9]"
    for bad in (lambda: p.set(0, 128), lambda: p.fill(-1), lambda: words.mask_for_width(65)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(IndexError):
        p.set(3, 1)


def test_four_symbols(spark):
    values = [0, 3, 2, 2, 1, 3, 0, 2]
    q = bits.SymbolColumn(rows_of(spark, values))
    assert q.rank_all(6) == [1, 1, 2, 2] and q.rank(2, 8) == 3 and q.select(2, 2) == 7
    assert q.rank_all_pair(2, 6) == ([1, 0, 0, 1], [1, 1, 2, 2]) and str(q) == "03221302"
    assert str(q.set_symbols({0: 3, 7: 1})) == "33221301" and str(q.clear_symbol(1)) == "00221302"
    for symbols, error in (({0: 4}, ValueError), ({0: -1}, ValueError), ({8: 1}, IndexError)):
        with pytest.raises(error):
            q.set_symbols(symbols)
    assert q.storage_bytes() == {"raw": 8, "auxiliary": 64 + 16, "allocated": 88} and q.view_bytes() == 64 + 64 + 64 + 4 * 8
    with pytest.raises(ValueError):
        bits.SymbolColumn(rows_of(spark, [4]))


@pytest.mark.parametrize(("values", "universe"), [([0, 3, 7, 10, 15, 31], 32), ([0, 0, 0, 1, 1, 5, 5, 5, 9], 10)])
def test_sorted_column(spark, values, universe):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x long")
    s = ordered.SortedColumn(rows, universe)
    queries = spark.createDataFrame([(v, v) for v in range(universe)], "qid long, v long")
    got = {r["v"]: (r["lower_bound"], r["upper_bound"], r["predecessor"]) for r in ordered.bounds_batch(rows, queries).collect()}
    for v in range(universe):
        low, up = bisect.bisect_left(values, v), bisect.bisect_right(values, v)
        assert got[v] == (low, up, values[up - 1] if up else None)
    v = values[2]
    assert (s.lower_bound(v), s.upper_bound(v), s.contains(v), s.predecessor(v), s.successor(v)) == (values.index(v), bisect.bisect_right(values, v), True, v, v)
    for high in range(5):
        assert s.first_index_with_high_at_least(high) == sum(x >> s.low_bits < high for x in values) and s.first_index_with_high_greater_than(high) == sum(x >> s.low_bits <= high for x in values)
    assert list(s.items()) == values and s.last_less_equal(v) == bisect.bisect_right(values, v) - 1
    assert s.count_range(1, 6) == sum(1 <= x < 6 for x in values) and s.access(1) == values[1]


def test_sorted_errors(spark):
    for values, universe in (([0], 0), ([10], 10), ([0, 2, 1], 10)):
        with pytest.raises(ValueError):
            ordered.SortedColumn(spark.createDataFrame(list(enumerate(values)), "i long, x long"), universe)


def cycle_rows(lengths):
    out, at = [], 0
    for n in lengths:
        out += [(at + i, at + (i + 1) % n) for i in range(n)]
        at += n
    return out


@pytest.mark.parametrize(("lengths", "stride", "landmarks"), [([9], 8, 2), ([65], 8, 9), ([10, 2, 7], 4, 5)])
def test_permutation(spark, lengths, stride, landmarks):
    p = ordered.Permutation(spark.createDataFrame(cycle_rows(lengths), "idx long, image long"), stride)
    assert p.landmark_count() == landmarks
    assert p.inverse(p.forward(3)) == 3
    inverse = {r["idx"]: r["image"] for r in p.inverse_table().collect()}
    assert all(inverse[b] == a for a, b in cycle_rows(lengths))
    assert sorted({r["length"] for r in ordered.cycles(p.rows).collect()}) == sorted(set(lengths))


def test_permutation_errors(spark):
    for rows in ([(0, 0), (1, 0)], [(0, 1)], [(0, 0), (1, 2)]):
        with pytest.raises(ValueError):
            ordered.Permutation(spark.createDataFrame(rows, "idx long, image long"))
    with pytest.raises(ValueError):
        ordered.Permutation(spark.createDataFrame([(0, 0)], "idx long, image long"), 0)


def test_symbol_runs(spark):
    rng = random.Random(3)
    values = [rng.randrange(3) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(values)), "pos long, sym long")
    got = sorted(tuple(r) for r in suffix.symbol_runs(rows).collect())
    assert [s for _, s, a, b in got for _ in range(b - a)] == values
    assert all(x[1] != y[1] and x[3] == y[2] for x, y in zip(got, got[1:], strict=False))


def test_run_length_column(spark):
    values = [2, 2, 0, 1, 1, 1, 0, 2]
    r = suffix.RunLengthColumn(spark.createDataFrame(list(enumerate(values)), "pos long, sym long"))
    assert r.run_count() == 5 and r.memory_usage() == storage.run_length_bytes(8, 5)
    for i, v in enumerate(values):
        assert r.access_rank(i) == (v, values[:i].count(v))
    for sym in (0, 1, 2, 5):
        where = [i for i, v in enumerate(values) if v == sym]
        assert [r.select(sym, k) for k in range(-1, 4)] == [-1, *where, *[-1] * (4 - len(where))]
        assert r.rank_pair(sym, 1, 8) == (values[:1].count(sym), values.count(sym))
    with pytest.raises(IndexError):
        r.access(8)


def test_word_functions(spark):
    row = spark.range(1).select(words.ceil_div(F.lit(9), F.lit(4)), words.ceil_div(F.lit(0), F.lit(4)), words.align_up(F.lit(9), F.lit(8)), words.floor_log2(F.lit(1023)), words.floor_log2(F.lit(0)), words.nth_set_bit(F.lit(0b10110), F.lit(1)), words.nth_set_bit(F.lit(1), F.lit(1))).first()
    assert tuple(row) == (3, 0, 16, 9, 0, 2, -1)


def test_storage_formulas():
    assert [storage.bit_depth(n) for n in (0, 512, 513, 8192, 8193, 8_589_934_592, 8_589_934_593)] == [0, 0, 1, 1, 2, 8, -1]
    assert storage.bit_vector_bytes(513) == 128 + 32 and storage.bit_vector_bytes(0) == 0
    assert storage.packed_words(65, 7) == 8
    assert storage.quad_bytes((4096, 1, 0, 0)) == {"raw": 1032, "rank": 128, "select": 20, "auxiliary": 148, "allocated": 1180}
    assert storage.backend_choice(1_000_000, 10) == "run-length" and storage.backend_choice(1000, 900) == "hybrid"


def test_save_and_load(spark, tmp_path):
    rows = rows_of(spark, [3, 1, 2])
    store.save(rows, str(tmp_path / "t"), width=2, built=True)
    back, about = store.load(spark, str(tmp_path / "t"), ("pos", "value"))
    assert about == {"built": True, "width": 2} and sorted(map(tuple, back.collect())) == [(0, 3), (1, 1), (2, 2)]
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "t"), ("nothing",))


def test_reopening_is_checked(spark, tmp_path):
    rows = rows_of(spark, [3, 1, 2])
    store.save(rows, str(tmp_path / "t"), kind="quad", width=2, n=3)
    back, about = store.reopen(spark, str(tmp_path / "t"), "quad", 2)
    assert about["n"] == 3 == back.count()
    store.save(rows.where("pos <> 1"), str(tmp_path / "gap"), kind="quad", width=2, n=2)
    store.save(rows, str(tmp_path / "short"), kind="quad", width=2, n=4)
    for path, kind, width in (("t", "msb", 2), ("t", "quad", 3), ("gap", "quad", 2), ("short", "quad", 2)):
        with pytest.raises(ValueError):
            store.reopen(spark, str(tmp_path / path), kind, width)


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError):
        scratch.shared_dir(Session())


def test_view_and_level_bytes():
    assert storage.bit_depth(268_435_457) == 7 and storage.bit_depth(2_147_483_649) == 8
    assert storage.bit_view_bytes(513) == storage.bit_vector_bytes(513)
    assert [storage.quad_view_bytes(n) for n in (0, 1, 33)] == [0, 64 + 64 + 8, 64 + 64 + 32]
    assert storage.quad_wavelet_view_bytes(33, 0) == 0 and storage.quad_wavelet_view_bytes(33, 3) == 64 + 192 + 160
    assert storage.hybrid_actual_bytes(0, []) == 136
    with pytest.raises(ValueError):
        storage.quad_view_bytes(-1)


def test_count_before_with_hot_key(spark):
    rows = spark.createDataFrame([(5,)] * 300 + [(6,)], "x long")
    queries = spark.createDataFrame([(5,), (6,), (7,), (None,), (6,)], "v long")
    assert {r["v"]: (r["below"], r["equal"]) for r in positions.bounds(rows, "x", queries, "v").collect()} == {5: (0, 300), 6: (300, 1), 7: (301, 0)}


def test_sparse_keys_are_not_ordered_in_one_task(spark, monkeypatch):
    """Keys far apart: numbered by range partitions, no exchange to a single partition over rows."""
    monkeypatch.setattr(positions, "few", lambda df, most=0: False)
    keys = [i * 70_000_000_019 for i in range(2000)]
    rows = spark.createDataFrame([(k,) for k in keys], "x long")
    queries = spark.createDataFrame([(k + d,) for k in keys[::7] for d in (-1, 0, 1)], "v long")
    found = positions.bounds(rows, "x", queries, "v")
    assert {(r["v"], r["below"], r["equal"]) for r in found.collect()} == {(k + d, i + (d > 0), int(d == 0)) for i, k in list(enumerate(keys))[::7] for d in (-1, 0, 1)}
    seen = []
    monkeypatch.setattr(positions, "written", lambda df, name: seen.append(df) or written(df, name))
    positions.bounds(rows, "x", queries, "v").count()
    plans = "\n".join(d._jdf.queryExecution().executedPlan().toString() for d in [*seen, positions.bounds(rows, "x", queries, "v")])
    single = [x for x in plans.split("\n") if "SinglePartition" in x]
    assert len(seen) >= 2 and all("_g" in plans or "_p" in plans for _ in single)
    windows = [x for x in plans.split("\n") if "Window [" in x]
    assert windows and all(", [_b" in x or ", [_g" in x or ", [_p" in x or "_t_" in x or "_n#" in x for x in windows)
