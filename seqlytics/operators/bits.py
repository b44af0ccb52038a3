"""Bit columns (pos, bit), four-symbol columns (pos, sym) and packed columns (pos, value of a fixed width).

Tables are immutable: an update returns a new table. A bit column has a capacity and a logical length, the highest position ever written plus one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlytics import guards
from seqlytics.functions.words import mask_for_width
from seqlytics.operators import runs
from seqlytics.operators.positions import block_of, kth_position, ordinals, running_before
from seqlytics.operators.sequence import QuadIndex
from seqlytics.operators.storage import LEVEL_BITS

#: Fixed value.
MOST_SYMBOLS = (1 << 43) - 1


def updated(rows: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """``rows`` (pos, column) with the values of ``updates`` where it has the position."""
    new = updates.select("pos", F.col(column).alias("_new"))
    return rows.join(new, "pos", "left").select("pos", F.coalesce("_new", column).alias(column))


def bit_ranks(rows: DataFrame) -> DataFrame:
    """(pos, bit, rank1, rank0, rank1_incl, rank0_incl) for all positions."""
    one = F.when(F.col("bit"), 1).otherwise(0).cast("long")
    out = running_before(rows, "pos", {"rank1": one})
    return out.select("pos", "bit", "rank1", (F.col("pos") - F.col("rank1")).alias("rank0"), (F.col("rank1") + one).alias("rank1_incl"), (F.col("pos") + 1 - F.col("rank1") - one).alias("rank0_incl"))


def ranks_in_block(rows: DataFrame, level: int = 1) -> DataFrame:
    """(pos, bit, rank): ones before each position inside its block of a level."""
    w = Window.partitionBy(block_of("pos", LEVEL_BITS[level - 1])).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("pos", "bit", F.coalesce(F.sum(F.col("bit").cast("long")).over(w), F.lit(0)).alias("rank"))


def bit_selects(rows: DataFrame) -> DataFrame:
    """(bit, k, pos): the position of the k-th (0-based) one and zero."""
    return ordinals(rows, "pos", ("bit",), "k").select("bit", "k", "pos")


def level_counts(rows: DataFrame, level: int) -> DataFrame:
    """(block, ones, before): ones in each block of a level, and before it inside the enclosing block of the next level (all, at level 8)."""
    size = LEVEL_BITS[level - 1]
    counts = rows.groupBy(block_of("pos", size).alias("block")).agg(F.count_if("bit").alias("ones"))
    fan = LEVEL_BITS[level] // size if level < len(LEVEL_BITS) else 1 << 40
    out = counts.withColumn("parent", block_of("block", fan))
    return running_before(out, "block", {"before": F.col("ones")}, ("parent",)).select("block", "ones", "before")


@dataclass(frozen=True)
class BitColumn:
    rows: DataFrame
    capacity: int
    length: int

    @staticmethod
    def empty(spark: SparkSession, capacity: int) -> BitColumn:
        if capacity < 0:
            raise ValueError("a capacity is not negative")
        return BitColumn(spark.range(capacity).select(F.col("id").alias("pos"), F.lit(False).alias("bit")), capacity, 0)

    @staticmethod
    def of(spark: SparkSession, text: str) -> BitColumn:
        rows = spark.createDataFrame([(i, c == "1") for i, c in enumerate(text)], "pos long, bit boolean")
        return BitColumn(rows, len(text), len(text))

    def write(self, bits: dict[int, bool]) -> BitColumn:
        """Sets or clears positions; either makes the logical length grow."""
        for p in bits:
            guards.check_index(p, self.capacity)
        new = self.rows.sparkSession.createDataFrame(list(bits.items()), "pos long, bit boolean")
        return replace(self, rows=updated(self.rows, new, "bit"), length=max(self.length, *(p + 1 for p in bits)) if bits else self.length)

    def access(self, i: int) -> bool:
        guards.check_index(i, self.capacity)
        return self.rows.where(F.col("pos") == i).first()["bit"]

    def rank1(self, p: int) -> int:
        guards.check_position(p, self.capacity)
        return self.rows.agg(F.count_if(F.col("bit") & (F.col("pos") < p))).first()[0]

    def rank0(self, p: int) -> int:
        return p - self.rank1(p)

    def rank1_pair(self, left: int, right: int) -> tuple[int, int]:
        """Ones before both positions, in one pass."""
        guards.check_range(left, right, self.capacity)
        return tuple(self.rows.agg(*[F.count_if(F.col("bit") & (F.col("pos") < p)) for p in (left, right)]).first())

    def select(self, bit: bool, k: int) -> int:
        return kth_position(self.rows.where(F.col("bit") == bit), k)

    def select1_nth(self, nth: int) -> int:
        """The position of the nth (1-based) one, or -1."""
        return self.select(True, nth - 1)

    def select0_nth(self, nth: int) -> int:
        return self.select(False, nth - 1)

    def cursor(self, bit: bool) -> Iterator[int]:
        """Positions of ones or zeros, ascending, fetched as they are asked for."""
        return (r["pos"] for r in self.rows.where(F.col("bit") == bit).orderBy("pos").toLocalIterator())

    def runs(self, bit: bool = True, left: int = 0, right: int | None = None) -> DataFrame:
        right = self.capacity if right is None else right
        guards.check_range(left, right, self.capacity)
        return runs.matching_runs(self.rows, F.col("bit") == bit, left, right)

    def __str__(self) -> str:
        return "".join("1" if r["bit"] else "0" for r in self.rows.where(F.col("pos") < self.length).orderBy("pos").collect())


@dataclass(frozen=True)
class PackedColumn:
    """Unsigned values of ``width`` bits."""

    rows: DataFrame
    n: int
    width: int

    @staticmethod
    def of(rows: DataFrame, width: int) -> PackedColumn:
        """ValueError if positions are not dense or a value does not fit."""
        top = mask_for_width(width)
        n, low, high, least, most = rows.agg(F.count(F.lit(1)), F.min("pos"), F.max("pos"), F.min("value"), F.max("value")).first()
        if n and (low != 0 or high != n - 1):
            raise ValueError("positions must be dense and start at 0")
        if n and (least < 0 or most > top):
            raise ValueError(f"a value does not fit {width} bits")
        return PackedColumn(rows.select("pos", "value"), n, width)

    @property
    def max_value(self) -> int:
        return mask_for_width(self.width)

    def get(self, i: int) -> int:
        guards.check_index(i, self.n)
        return int(self.rows.where(F.col("pos") == i).first()["value"])

    def set(self, i: int, value: int) -> PackedColumn:
        guards.check_index(i, self.n)
        guards.check_width(value, self.width)
        new = self.rows.sparkSession.createDataFrame([(i, value)], "pos long, value long")
        return replace(self, rows=updated(self.rows, new, "value"))

    def fill(self, value: int) -> PackedColumn:
        guards.check_width(value, self.width)
        return replace(self, rows=self.rows.select("pos", F.lit(value).cast("long").alias("value")))

    def items(self) -> Iterator[int]:
        """All values in order, fetched as they are asked for."""
        return (int(r["value"]) for r in self.rows.orderBy("pos").toLocalIterator())

    def to_list(self) -> list[int]:
        return list(self.items())

    def __str__(self) -> str:
        return "@[" + ", ".join(map(str, self.to_list())) + "]"


def symbol_ranks(rows: DataFrame) -> DataFrame:
    """(pos, sym, r0..r3): how often each symbol occurs before each position, in one pass."""
    return running_before(rows, "pos", {f"r{s}": F.when(F.col("sym") == s, 1).otherwise(0).cast("long") for s in range(4)})


class SymbolColumn(QuadIndex):
    """Symbols 0 to 3."""

    def __init__(self, rows: DataFrame) -> None:
        super().__init__(rows, 2)
        if self.n > MOST_SYMBOLS:
            raise ValueError("too many symbols")

    def rank_all(self, p: int) -> list[int]:
        guards.check_position(p, self.n)
        return list(self.rows.where(F.col("pos") < p).agg(*[F.count_if(F.col("value") == s) for s in range(4)]).first())

    def rank_all_pair(self, left: int, right: int) -> tuple[list[int], list[int]]:
        """``rank_all`` of both positions, in one pass."""
        guards.check_range(left, right, self.n)
        found = self.rows.agg(*[F.count_if((F.col("value") == s) & (F.col("pos") < p)) for p in (left, right) for s in range(4)]).first()
        return list(found[:4]), list(found[4:])

    def set_symbols(self, symbols: dict[int, int]) -> SymbolColumn:
        """A column with other symbols at some positions."""
        for p, s in symbols.items():
            guards.check_index(p, self.n)
            if not 0 <= s <= 3:
                raise ValueError("a symbol is 0 to 3")
        new = self.rows.sparkSession.createDataFrame(list(symbols.items()), "pos long, value long")
        return SymbolColumn(updated(self.rows, new, "value"))

    def clear_symbol(self, p: int) -> SymbolColumn:
        return self.set_symbols({p: 0})

    def __str__(self) -> str:
        return "".join(map(str, self.to_list()))
