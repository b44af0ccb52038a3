"""Questions on ranges and values in groups: against naive answers, with groups of a few rows."""

import random

import numpy as np
import pytest

from seqlytics.operators import ranges, sequence


@pytest.fixture
def small_groups(monkeypatch):
    """Blocks and chunks of 16, windows for ranges up to 8, five questions a task; no batch counts as few."""
    for name, n in (("SIDE", 16), ("NEAR", 8), ("SHARE", 5)):
        monkeypatch.setattr(ranges, name, n)
    monkeypatch.setattr(sequence, "NEAR", 8)
    monkeypatch.setattr(sequence, "BROADCAST_QUERIES", 0)


def rows_of(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, value long")


def forbidden(*_):
    raise AssertionError("a short range took rounds")


SHORT = [(q, max(0, q - q % 9), q, q % 11 - 1, q % 23) for q in range(131)] + [(200, 128, 136, 1, 9), (201, -3, 5, 4, 9), (202, 7, 7, 0, 9), (203, 130, 137, 0, 0)]


def test_kth_smallest_of_short_ranges_takes_no_rounds(spark, small_groups, monkeypatch):
    monkeypatch.setattr(sequence, "kth_smallest", forbidden)
    values = [x * 7919 % 20 for x in range(130)]
    got = sequence.quantile_batch(rows_of(spark, values), spark.createDataFrame(SHORT, "qid long, l long, r long, k long, v long"))
    found = {r["qid"]: r["quantile"] for r in got.collect()}
    for q, a, b, k, _ in SHORT:
        part = sorted(values[max(0, a) : b])
        assert found[q] == (part[k] if 0 <= k < len(part) else None)


def test_matrix():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 64, 200):
        values, weights = rng.integers(0, 1 + n // 3, n), rng.integers(1, 9, n)
        ends = np.sort(rng.integers(0, n + 1, (300, 2)), axis=1)
        v, k, (l, r) = rng.integers(-1, n // 3 + 3, 300), rng.integers(-1, n + 2, 300), ends.T
        matrix, heavy = ranges.Matrix(values), ranges.Matrix(values, weights)
        less, heavier, kth = matrix.less(l, r, v), heavy.less(l, r, v), matrix.kth(l, r, k)
        for i in range(300):
            part = values[l[i] : r[i]]
            assert less[i] == (part < v[i]).sum() and heavier[i] == weights[l[i] : r[i]][part < v[i]].sum()
            assert (None if np.ma.getmaskarray(kth)[i] else kth[i]) == (np.sort(part)[k[i]] if 0 <= k[i] < len(part) else None)


def neighbours(spark, which):
    """What each short question is told, and the naive answers."""
    values = [x * 7919 % 20 for x in range(130)]
    got = sequence.neighbour_batch(rows_of(spark, values), spark.createDataFrame(SHORT, "qid long, l long, r long, k long, v long"), (which,))
    best, side = {"predecessor": (max, lambda x, v: x < v), "successor": (min, lambda x, v: x >= v)}[which]
    want = {q: best((x for x in values[max(0, a) : b] if side(x, v)), default=None) for q, a, b, _, v in SHORT}
    return {r["qid"]: r[which] for r in got.collect()}, want


def test_predecessor_of_short_ranges_takes_no_rounds(spark, small_groups, monkeypatch):
    monkeypatch.setattr(sequence, "kth_smallest", forbidden)
    got, want = neighbours(spark, "predecessor")
    assert got == want


def test_successor_of_short_ranges_takes_no_rounds(spark, small_groups, monkeypatch):
    monkeypatch.setattr(sequence, "kth_smallest", forbidden)
    got, want = neighbours(spark, "successor")
    assert got == want


def test_short_and_long_ranges_in_one_batch(spark, small_groups):
    rng = random.Random(6)
    values = [rng.randrange(30) for _ in range(120)]
    asked = [(q, *sorted((rng.randrange(121), rng.randrange(121))), rng.randrange(-1, 40), rng.randrange(32)) for q in range(70)] + [r for r in SHORT if r[0] >= 100]
    queries = spark.createDataFrame(asked, "qid long, l long, r long, k long, v long")
    kth = {r["qid"]: r["quantile"] for r in sequence.quantile_batch(rows_of(spark, values), queries).collect()}
    near = {r["qid"]: (r["predecessor"], r["successor"]) for r in sequence.neighbour_batch(rows_of(spark, values), queries).collect()}
    for q, a, b, k, v in asked:
        part = sorted(values[max(0, a) : b])
        assert kth[q] == (part[k] if 0 <= k < len(part) else None)
        assert near[q] == (max((x for x in part if x < v), default=None), min((x for x in part if x >= v), default=None))


def naive_counts(values, asked):
    part = {q: values[max(0, a) : b] for q, a, b, *_ in asked}
    return {q: sum(x < v for x in part[q]) for q, _, _, v, _, _ in asked}, {q: sum(lo <= x < hi for x in part[q]) for q, _, _, _, lo, hi in asked}


@pytest.mark.parametrize("most", [1 << 10, 4])
@pytest.mark.parametrize("spread", [3, 400])
def test_counts_by_blocks_and_chunks(spark, small_groups, monkeypatch, most, spread):
    """Many blocks and chunks, few of both, and few values that many rows have."""
    monkeypatch.setattr(ranges, "MOST", most)
    rng = random.Random(7)
    values = [rng.randrange(spread) for _ in range(300)]
    asked = [(q, *sorted((rng.randrange(301), rng.randrange(301))), *(rng.randrange(-2, spread + 3) for _ in range(3))) for q in range(90)]
    asked += [(100, 0, 300, spread, 0, spread), (101, 64, 128, 1, 0, 1), (102, -5, 999, 2, 2, 1), (103, 20, 10, 2, 0, 2), (104, 16, 16, 2, 0, 2), (105, 300, 310, 2, 0, 2)]
    queries = spark.createDataFrame(asked, "qid long, l long, r long, v long, lo long, hi long")
    less, inside = naive_counts(values, asked)
    assert {r["qid"]: r["n_less"] for r in sequence.count_less_batch(rows_of(spark, values), queries).collect()} == less
    assert {r["qid"]: r["n_in"] for r in sequence.range_freq_batch(rows_of(spark, values), queries).collect()} == inside


def given(monkeypatch, f):
    """How many rows and questions reach the groups while ``f`` runs."""
    seen, met = [], ranges.met
    monkeypatch.setattr(ranges, "met", lambda rows, asked, *rest: seen.append((rows.count(), asked.count())) or met(rows, asked, *rest))
    f()
    return seen[0]


def test_value_ranges_are_asked_four_times_at_most(spark, small_groups, monkeypatch):
    """Whatever the number of bits of the values: rows in a block and a chunk, a question at two blocks and with two bounds."""
    values = [x * 7919 % (1 << 40) for x in range(300)]
    queries = spark.createDataFrame([(q, q // 3, q, q * 5000, q * 90000) for q in range(300)], "qid long, l long, r long, lo long, hi long")
    rows, asked = given(monkeypatch, lambda: sequence.range_freq_batch(rows_of(spark, values), queries))
    assert rows <= 2 * 300 and asked <= 4 * 300


def test_no_rows(spark, small_groups):
    queries = spark.createDataFrame([(1, 0, 5, 3, 0, 3)], "qid long, l long, r long, v long, lo long, hi long")
    none = rows_of(spark, [1]).where("pos < 0")
    assert sequence.count_less_batch(none, queries).first()["n_less"] == sequence.range_freq_batch(none, queries).first()["n_in"] == 0
    assert sequence.quantile_batch(none, queries.withColumn("k", queries.v)).first()["quantile"] is None


def test_smaller_values_before_a_position_are_asked_twice_at_most(spark, small_groups, monkeypatch):
    """As in the numeric order: a question at the block of its position and with its bound."""
    values = [x * 7919 % (1 << 40) for x in range(300)]
    queries = spark.createDataFrame([(q, 0, q, values[q]) for q in range(300)], "qid long, l long, r long, v long")
    rows, asked = given(monkeypatch, lambda: sequence.count_less_batch(rows_of(spark, values), queries))
    assert rows <= 2 * 300 and asked <= 2 * 300


def test_ranks_of_smaller_values_in_crowded_groups(spark, small_groups):
    """All questions at one position, then all with one bound."""
    values = [x * 7 % 50 for x in range(300)]
    for asked in ([(q, 0, 299, q % 50) for q in range(200)], [(q, 0, q, 25) for q in range(200)]):
        answers = sequence.count_less_batch(rows_of(spark, values), spark.createDataFrame(asked, "qid long, l long, r long, v long")).collect()
        assert {r["qid"]: r["n_less"] for r in answers} == {q: sum(x < v for x in values[:b]) for q, _, b, v in asked}


def test_smaller_values_in_ranges_are_asked_three_times_at_most(spark, small_groups, monkeypatch):
    values = [x * 7919 % (1 << 40) for x in range(300)]
    queries = spark.createDataFrame([(q, q // 3, q, values[q]) for q in range(300)], "qid long, l long, r long, v long")
    rows, asked = given(monkeypatch, lambda: sequence.count_less_batch(rows_of(spark, values), queries))
    assert rows <= 2 * 300 and asked <= 3 * 300
