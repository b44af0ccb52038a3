"""Column arithmetic on unsigned words, bits and digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_div(x: Column, y: Column) -> Column:
    """ceil(x / y) for positive x, else 0."""
    return F.when(x <= 0, F.lit(0)).otherwise(F.floor((x + y - 1 - F.pmod(x + y - 1, y)) / y)).cast("long")


def align_up(x: Column, a: Column) -> Column:
    return (ceil_div(x, a) * a).cast("long")


def mask_for_width(width: int) -> int:
    """The largest value of ``width`` bits, 0 to 64."""
    if not 0 <= width <= 64:
        raise ValueError("a width is 0 to 64 bits")
    return (1 << width) - 1


def bit_width(largest: int) -> int:
    """Bits of an inferred width: at least 1."""
    return max(1, int(largest).bit_length())


def floor_log2(x: Column) -> Column:
    """floor(log2(x)), 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)) - 1).cast("long")


def reversed_bits(value: Column, width: int) -> Column:
    """A string that sorts as the bit-reversed value."""
    return F.reverse(F.lpad(F.conv(value.cast("string"), 10, 2), max(1, width), "0"))


def reversed_digits(value: Column, width: int) -> Column:
    """A string that sorts as the value with its base-4 digits reversed; an odd width is padded on top."""
    levels = max(1, (width + 1) // 2)
    return F.reverse(F.lpad(F.conv(value.cast("string"), 10, 4), levels, "0"))


def nth_set_bit(word: Column, n: Column) -> Column:
    """Position of the n-th (0-based) one in a 64-bit word, or -1."""
    ones = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(word.cast("long"), i) == 1)
    return F.coalesce(F.get(ones, n.cast("int")), F.lit(-1)).cast("long")
