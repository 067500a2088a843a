"""Fuzzy entropy of class masses, and what else is read off them."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def x_log_x(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def entropy(masses: list[Column]) -> Column:
    """Entropy in bits of a node's class masses, given as one column per class; 0 for no mass."""
    total = sum(masses[1:], masses[0])
    inner = x_log_x(total) - sum((x_log_x(m) for m in masses[1:]), x_log_x(masses[0]))
    return F.when(total > 0, inner / (total * math.log(2))).otherwise(0.0)


def entropy_array(masses: Column) -> Column:
    total = F.aggregate(masses, F.lit(0.0), lambda s, m: s + m)
    inner = x_log_x(total) - F.aggregate(masses, F.lit(0.0), lambda s, m: s + x_log_x(m))
    return F.when(total > 0, inner / (total * math.log(2))).otherwise(0.0)


def entropy_value(masses) -> float:
    total = float(sum(masses))
    if total <= 0:
        return 0.0
    return float((sum(-w * math.log(w) for w in masses if w > 0) + total * math.log(total)) / (total * math.log(2)))


def weight(mass: Column, digits: int = 9) -> Column:
    """The whole number of a mass, which weighs a child in the gain; rounded first, so that summation order does not matter."""
    return F.floor(F.round(mass, digits)).cast("double")


def weight_value(mass: float, digits: int = 9) -> float:
    return float(math.floor(round(mass, digits)))


def majority(masses: Column) -> Column:
    """First class of largest mass; 0 if the whole number of the masses is 0."""
    total = F.aggregate(masses, F.lit(0.0), lambda s, m: s + m)
    return F.when(total < 1, 0).otherwise(F.array_position(masses, F.array_max(masses)) - 1).cast("int")


def class_weights(masses: Column) -> Column:
    total = F.aggregate(masses, F.lit(0.0), lambda s, m: s + m)
    return F.transform(masses, lambda m: F.when(total > 0, F.try_divide(m, total)).otherwise(0.0))


def class_frequencies(counts: Column) -> Column:
    """Each class's share of the row counts; 0 without rows."""
    return class_weights(F.transform(counts, lambda f: f.cast("double")))


def is_mono_label(counts: Column) -> Column:
    """Whether rows of exactly one class are there."""
    return F.size(F.filter(counts, lambda f: f > 0)) == 1


IMPURITIES = {"fuzzy_entropy": (entropy, entropy_value)}


def impurity(name: str):
    if name.lower() not in IMPURITIES:
        raise ValueError(f"unknown impurity {name!r}")
    return IMPURITIES[name.lower()]
