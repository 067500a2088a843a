"""Rows to fuzzy bins: one narrow projection."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzysets import Triangular


def _bin(i: int, md: Column) -> Column:
    return F.struct(F.lit(i).alias("bin"), md.alias("md"))


def continuous_bins(x: Column, cores) -> Column:
    """The one or two sets that x fires, with degrees that add up to 1; NaN, infinity and null raise."""
    p = sorted(map(float, cores))
    x = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("no fuzzy set holds this value")).cast("double")).otherwise(x)
    out = F.when(x <= p[0], F.array(_bin(0, F.lit(1.0))))
    for i in range(len(p) - 1):
        mu = F.lit(1.0) - (x - F.lit(p[i])) / F.lit(p[i + 1] - p[i])
        out = out.when(x < p[i + 1], F.array(_bin(i, mu), _bin(i + 1, F.lit(1.0) - mu))).when(x == p[i + 1], F.array(_bin(i + 1, F.lit(1.0))))
    return out.otherwise(F.array(_bin(len(p) - 1, F.lit(1.0))))


def categorical_bins(x: Column, arity: int) -> Column:
    """The category's bin with degree 1; values outside 0 .. arity - 1, fractions, NaN and null raise."""
    ok = x.isNotNull() & ~F.isnan(x.cast("double")) & (x >= 0) & (x < arity) & (F.floor(x) == x)
    code = F.when(ok, x.cast("int")).otherwise(F.raise_error(F.lit("no such category")).cast("int"))
    return F.array(F.struct(code.alias("bin"), F.lit(1.0).alias("md")))


def feature_bins(x: Column, sets) -> Column:
    if isinstance(sets[0], Triangular):
        return continuous_bins(x.cast("double"), [s.b for s in sets])
    return categorical_bins(x, len(sets))


def checked_label(label: Column, num_classes: int) -> Column:
    return F.when((label >= 0) & (label < num_classes), label.cast("int")).otherwise(F.raise_error(F.lit("label outside 0 .. num_classes - 1")).cast("int"))


def fuzzify(df: DataFrame, features: list[str], label: str, metadata, weight: str | None = None) -> DataFrame:
    """(label, bins, w): bins is an array over features of arrays of (bin, md), w how many rows this one stands for."""
    bins = [feature_bins(F.col(c), s) for c, s in zip(features, metadata.sets)]
    return df.select(checked_label(F.col(label), metadata.params.num_classes).alias("label"), F.array(*bins).alias("bins"), (F.col(weight) if weight else F.lit(1).cast("long")).alias("w"))
