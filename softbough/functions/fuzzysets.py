"""Fuzzy sets as Column expressions: strong triangular partitions and singletons."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Triangular:
    """Support (a, c), peak at b; a or c None is an open shoulder. NaN and null lie in no set."""

    a: float | None
    b: float
    c: float | None

    def membership(self, x: Column) -> Column:
        rise = F.lit(1.0) if self.a is None else (x - F.lit(self.a)) / F.lit(self.b - self.a)
        fall = F.lit(1.0) if self.c is None else F.lit(1.0) - (x - F.lit(self.b)) / F.lit(self.c - self.b)
        return F.when(self.in_support(x) & (x <= self.b), rise).when(self.in_support(x), fall).otherwise(0.0)

    def in_support(self, x: Column) -> Column:
        number = x.isNotNull() & ~F.isnan(x.cast("double"))
        low = number if self.a is None else number & (x > self.a)
        return low if self.c is None else low & (x < self.c)

    def value(self, x: float) -> float:
        if x != x or (self.a is not None and x <= self.a) or (self.c is not None and x >= self.c):  # NaN differs from itself
            return 0.0
        if x <= self.b:
            return 1.0 if self.a is None else (x - self.a) / (self.b - self.a)
        return 1.0 if self.c is None else 1.0 - (x - self.b) / (self.c - self.b)


@dataclass(frozen=True)
class Singleton:
    b: float
    a = c = None

    def membership(self, x: Column) -> Column:
        return F.when(x == self.b, 1.0).otherwise(0.0)

    def in_support(self, x: Column) -> Column:
        return x == self.b

    def value(self, x: float) -> float:
        return float(x == self.b)


def triangular_set(points) -> Triangular:
    if len(points) != 3:
        raise ValueError("a triangular set has three points")
    return Triangular(*map(float, sorted(points)))


def triangular_partition(cores) -> list[Triangular]:
    """The strong partition whose peaks are the cores: at any x the degrees add up to 1."""
    p = sorted(map(float, cores))
    if len(p) < 2 or len(set(p)) < len(p):
        raise ValueError("a strong partition has two or more distinct cores")
    ends = [None, *p, None]
    return [Triangular(ends[i], p[i], ends[i + 2]) for i in range(len(p))]


def singleton_set(points) -> Singleton:
    if len(points) != 1:
        raise ValueError("a singleton has one point")
    return Singleton(float(points[0]))


def singleton_partition(points) -> list[Singleton]:
    return [Singleton(float(p)) for p in sorted(points)]


FUZZY_SETS = {"triangular": (triangular_set, triangular_partition), "singleton": (singleton_set, singleton_partition)}


def fuzzy_set_builder(name: str):
    """(one set, partition) builders by name, in any case."""
    if name.lower() not in FUZZY_SETS:
        raise ValueError(f"unknown fuzzy set {name!r}")
    return FUZZY_SETS[name.lower()]


def equal_width_cores(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def quantile_cores(df, column: str, n: int, accuracy: int = 10_000) -> list[float]:
    """Distinct cores at n quantiles of a column."""
    got = df.agg(F.percentile_approx(column, [i / (n - 1) for i in range(n)], accuracy)).first()[0]
    return sorted(set(map(float, got)))
