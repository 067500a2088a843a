"""T-norms: a fold from 1 over degrees, as Column expressions and on numbers."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Product:
    name = "product"

    @staticmethod
    def column(*degrees: Column) -> Column:
        return reduce(lambda a, b: a * b, degrees, F.lit(1.0))

    @staticmethod
    def value(*degrees):
        return reduce(lambda a, b: a * b, degrees, 1.0)


class Min:
    name = "min"

    @staticmethod
    def column(*degrees: Column) -> Column:
        return F.least(F.lit(1.0), *degrees) if degrees else F.lit(1.0)

    @staticmethod
    def value(*degrees):
        import numpy as np

        return reduce(np.minimum, degrees, 1.0)


TNORMS = {t.name: t for t in (Product, Min)}


def tnorm(name: str):
    if name.lower() not in TNORMS:
        raise ValueError(f"unknown t-norm {name!r}")
    return TNORMS[name.lower()]
