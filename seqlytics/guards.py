"""Checks of scalar arguments, in the order index, range, value."""

from __future__ import annotations


def check_index(i: int, n: int) -> None:
    if not 0 <= i < n:
        raise IndexError(f"index {i} is not in 0 to {n - 1}")


def check_position(p: int, n: int) -> None:
    if not 0 <= p <= n:
        raise IndexError(f"position {p} is not in 0 to {n}")


def check_range(left: int, right: int, n: int) -> None:
    if not 0 <= left <= right <= n:
        raise IndexError(f"range {left} to {right} is not in 0 to {n}")


def check_width(value: int, width: int) -> None:
    if not 0 <= value < 1 << width:
        raise ValueError(f"{value} does not fit {width} bits")
