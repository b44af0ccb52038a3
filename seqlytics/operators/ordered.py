"""Sorted integers (i, x) and permutations (idx, image)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlytics import guards
from seqlytics.operators.positions import bounds, sums_in_order
from seqlytics.sources.scratch import written


def bounds_batch(rows: DataFrame, queries: DataFrame, at: str = "v") -> DataFrame:
    """``queries`` with lower_bound and upper_bound, the first indexes with x >= v and x > v, and predecessor, the largest x <= v, or null. One order serves both bounds."""
    found = bounds(rows, "x", queries, at).select(at, F.col("below").alias("lower_bound"), (F.col("below") + F.col("equal")).alias("upper_bound"))
    before = rows.select((F.col("i") + 1).alias("upper_bound"), F.col("x").alias("predecessor"))
    return queries.join(found.join(before, "upper_bound", "left").select(at, "lower_bound", "upper_bound", "predecessor"), at)


class SortedColumn:
    """A nondecreasing column below an exclusive ``universe``."""

    def __init__(self, rows: DataFrame, universe: int) -> None:
        self.rows, self.universe = rows.select("i", "x"), universe
        n, top, low = self.rows.agg(F.count(F.lit(1)), F.max("x"), F.min("x")).first()
        if n and (universe <= 0 or top >= universe or low < 0):
            raise ValueError("values must be below the universe")
        following = self.rows.select((F.col("i") - 1).alias("i"), F.col("x").alias("next"))
        if self.rows.join(following, "i").where("next < x").limit(1).count():
            raise ValueError("values must not decrease")
        self.n = n

    @property
    def low_bits(self) -> int:
        q = self.universe // self.n if self.n else 0
        return q.bit_length() - 1 if q else 0

    def _count(self, condition) -> int:
        return self.rows.agg(F.count_if(condition)).first()[0]

    def access(self, i: int) -> int:
        guards.check_index(i, self.n)
        return self.rows.where(F.col("i") == i).first()["x"]

    __getitem__ = select = access

    def lower_bound(self, v: int) -> int:
        return self._count(F.col("x") < v)

    def upper_bound(self, v: int) -> int:
        return self._count(F.col("x") <= v)

    def contains(self, v: int) -> bool:
        return self.rows.where(F.col("x") == v).limit(1).count() > 0

    def last_index_at_most(self, v: int) -> int:
        return self.upper_bound(v) - 1

    last_less_equal = predecessor_index = last_index_at_most
    count_less_than = lower_bound
    count_less_equal = upper_bound

    def first_index_with_high_at_least(self, high: int) -> int:
        """The first index whose value, without its low bits, is at least ``high``; n if there is none."""
        return self._count(F.shiftrightunsigned("x", self.low_bits) < high)

    def first_index_with_high_greater_than(self, high: int) -> int:
        return self._count(F.shiftrightunsigned("x", self.low_bits) <= high)

    def items(self) -> Iterator[int]:
        return (r["x"] for r in self.rows.orderBy("i").toLocalIterator())

    def predecessor(self, v: int) -> int:
        """The largest x at or below ``v``."""
        if (k := self.upper_bound(v)) == 0:
            raise ValueError("there is no such value")
        return self.access(k - 1)

    def successor(self, v: int) -> int:
        """The smallest x at or above ``v``."""
        if (k := self.lower_bound(v)) == self.n:
            raise ValueError("there is no such value")
        return self.access(k)

    def count_range(self, low: int, high: int) -> int:
        return max(0, self.lower_bound(high) - self.lower_bound(low))


def cycles(rows: DataFrame) -> DataFrame:
    """(idx, leader, length) of a permutation: the smallest index of each index's cycle. Pointer doubling: as many rounds as the longest cycle has bits."""
    now = written(rows.select("idx", "image", F.least("idx", "image").alias("leader")), "cycles")
    while True:
        hop = now.select(F.col("idx").alias("image"), F.col("image").alias("_far"), F.col("leader").alias("_lead"))
        after = now.join(hop, "image").select("idx", F.col("_far").alias("image"), F.least("leader", "_lead").alias("leader"), (F.col("_lead") < F.col("leader")).alias("_moved"))
        after = written(after, "cycles")
        if not after.where("_moved").limit(1).count():
            lengths = after.groupBy("leader").agg(F.count(F.lit(1)).alias("length"))
            return after.join(lengths, "leader").select("idx", "leader", "length")
        now = after.drop("_moved")


def landmark_counts(found: DataFrame, stride: int) -> DataFrame:
    """(leader, length, landmarks) for each cycle: ceil(length / stride) where it is longer than ``stride``, else 0."""
    if stride <= 0:
        raise ValueError("a stride is positive")
    each = found.select("leader", "length").distinct()
    return each.withColumn("landmarks", F.when(F.col("length") > stride, F.ceil(F.col("length") / stride)).otherwise(0).cast("long"))


class Permutation:
    """A bijection (idx, image) on 0 to n - 1."""

    def __init__(self, rows: DataFrame, stride: int = 8) -> None:
        if stride <= 0:
            raise ValueError("a stride is positive")
        self.rows, self.stride = rows.select("idx", "image"), stride
        n, low, high, a, b, c, d = self.rows.agg(F.count(F.lit(1)), F.min("image"), F.max("image"), F.min("idx"), F.max("idx"), F.count_distinct("image"), F.count_distinct("idx")).first()
        if n and not (low == a == 0 and high == b == n - 1 and c == d == n):
            raise ValueError("not a bijection")
        self.n = n

    @property
    def bit_width(self) -> int:
        """Bits of the largest image."""
        return max(0, self.n - 1).bit_length()

    def forward(self, i: int) -> int:
        guards.check_index(i, self.n)
        return self.rows.where(F.col("idx") == i).first()["image"]

    __getitem__ = access = forward

    def items(self) -> Iterator[int]:
        return (r["image"] for r in self.rows.orderBy("idx").toLocalIterator())

    def inverse(self, y: int) -> int:
        guards.check_index(y, self.n)
        return self.rows.where(F.col("image") == y).first()["idx"]

    def inverse_table(self) -> DataFrame:
        return self.rows.select(F.col("image").alias("idx"), F.col("idx").alias("image"))

    def landmark_count(self) -> int:
        return landmark_counts(cycles(self.rows), self.stride).agg(F.coalesce(F.sum("landmarks"), F.lit(0))).first()[0] if self.n else 0


def high_buckets(rows: DataFrame, low_bits: int) -> DataFrame:
    """(high, first, past): the index range of each value of x without its low bits."""
    high = F.shiftrightunsigned("x", low_bits)
    counts = rows.groupBy(high.alias("high")).agg(F.count(F.lit(1)).alias("n"))
    placed = sums_in_order(counts, ("high",), {"first": "n"})
    return placed.select("high", "first", (F.col("first") + F.col("n")).cast("long").alias("past"))
