"""Hyper-parameters, and what follows from them and the data's schema."""
from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..functions.fuzzysets import Singleton, triangular_partition
from ..functions.impurity import impurity as impurity_by_name
from ..functions.tnorms import tnorm as tnorm_by_name

SPLIT_TYPES = ("binary_split", "multi_split")
MAX_DEPTH = 30


def split_type(name: str) -> str:
    if name.lower() not in SPLIT_TYPES:
        raise ValueError(f"unknown split type {name!r}")
    return name.lower()


@dataclass(frozen=True)
class TreeParams:
    """categories maps a feature's index to its arity, cores one's to its triangular peaks; each feature is in exactly one."""

    split: str = "binary_split"
    impurity: str = "fuzzy_entropy"
    tnorm: str = "product"
    max_depth: int | None = None
    max_bins: int = 32
    num_classes: int = 2
    categories: dict = field(default_factory=dict)
    cores: dict = field(default_factory=dict)
    min_instances: int = 1
    min_fuzzy_instances: float = 0.0
    max_purity: float = 1.0
    min_info_gain: float = 1e-6
    subsampling_rate: float = 1.0
    max_memory_mb: int = 256
    seed: int = 1

    def __post_init__(self):
        split_type(self.split)
        impurity_by_name(self.impurity)
        tnorm_by_name(self.tnorm)
        if self.max_depth is None:
            object.__setattr__(self, "max_depth", 10 if self.binary else 5)
        both = set(self.categories) & set(self.cores)
        for ok, what in (
            (self.num_classes >= 2, "num_classes is 2 or more"), (0 < self.max_depth <= MAX_DEPTH, f"max_depth is 1 to {MAX_DEPTH}"), (self.max_bins >= 2, "max_bins is 2 or more"),
            (not both, f"features {sorted(both)} are both categorical and continuous"), (self.min_instances >= 1, "min_instances is 1 or more"),
            (self.min_fuzzy_instances >= 0, "min_fuzzy_instances is 0 or more"), (0 < self.max_purity <= 1, "max_purity is in (0, 1]"),
            (0 < self.subsampling_rate <= 1, "subsampling_rate is in (0, 1]"), (0 < self.max_memory_mb <= 10240, "max_memory_mb is at most 10240"),
        ):
            if not ok:
                raise ValueError(what)

    @property
    def binary(self) -> bool:
        return self.split.lower() == "binary_split"


class Metadata:
    """Bins, fuzzy sets and orderedness of every feature, and the dictionary of value ids."""

    def __init__(self, params: TreeParams, num_features: int, num_examples: int):
        if num_examples <= 0 or num_features <= 0:
            raise ValueError("the training data has no rows or no features")
        missing = [f for f in range(num_features) if f not in params.categories and f not in params.cores]
        if missing:
            raise ValueError(f"features {missing} are neither categorical nor continuous")
        self.params, self.num_features, self.num_examples = params, num_features, num_examples
        self.max_possible_bins = min(params.max_bins, num_examples)
        self.sets = [triangular_partition(params.cores[f]) if f in params.cores else [Singleton(float(v)) for v in range(params.categories[f])] for f in range(num_features)]
        self.unordered = set()
        limit = int(math.log2(self.max_possible_bins // 2 + 1) + 1)
        for f in range(num_features):
            arity = params.categories.get(f)
            if arity is not None:
                if params.binary and arity < 2:
                    raise ValueError(f"feature {f} has one category only")
                if arity > self.max_possible_bins:
                    raise ValueError(f"feature {f} has {arity} categories, more than {self.max_possible_bins} bins")
                if params.num_classes > 2 and params.binary and arity <= limit:
                    self.unordered.add(f)
            elif params.binary and len(self.sets[f]) > self.max_possible_bins:
                raise ValueError(f"feature {f} has {len(self.sets[f])} fuzzy sets, more than {self.max_possible_bins} bins")
        self.first_id = [sum(len(s) for s in self.sets[:f]) for f in range(num_features)]

    def continuous(self, f: int) -> bool:
        return f in self.params.cores

    def bins(self, f: int) -> int:
        return len(self.sets[f])

    def num_splits(self, f: int) -> int:
        return (1 << (self.bins(f) - 1)) - 1 if f in self.unordered else self.bins(f) - 1

    def value_id(self, f: int, index: int) -> int:
        return self.first_id[f] + index

    def node_bytes(self) -> int:
        """What the masses and the counts of one node take."""
        return 16 * self.params.num_classes * sum(len(s) for s in self.sets)
