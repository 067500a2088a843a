"""Heap numbering of binary nodes and subset codes."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def left(i: int) -> int:
    return i << 1


def right(i: int) -> int:
    return (i << 1) + 1


def parent(i: int) -> int:
    return i >> 1


def level(i: int) -> int:
    if i < 1:
        raise ValueError("node ids begin at 1")
    return i.bit_length() - 1


def level_column(i: Column) -> Column:
    return F.length(F.bin(i)) - 1


def is_left_child(i: int) -> bool:
    return i > 1 and i % 2 == 0


def subset_positions(code: int, width: int) -> list[int]:
    """Positions of the 1-bits of code below width, from high to low."""
    return [j for j in range(width - 1, -1, -1) if code >> j & 1]


def subset_positions_column(code: Column, width: int) -> Column:
    return F.filter(F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)), lambda j: F.getbit(code, j) == 1)


def unordered_bins(arity: int) -> int:
    return 2 * ((1 << (arity - 1)) - 1)
